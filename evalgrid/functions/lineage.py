"""Model families and versions read from display labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a version inside a label.
_VERSION = r"(?i)(?<![a-z0-9.])k?(\d+(?:\.\d+)*)(?![a-z0-9.])"


def version_of(label: Column) -> Column:
    """The first version in ``label`` as an integer array, or null.

    Arrays compare element by element, so versions sort as numbers.
    """
    return F.when(
        label.rlike(_VERSION),
        F.transform(F.split(F.regexp_extract(label, _VERSION, 1), r"\."), lambda n: n.cast("bigint")),
    )


def family_of(label: Column) -> Column:
    """``label`` without its version, lower-cased, separators collapsed."""
    at = F.regexp_instr(label, F.lit(_VERSION))
    found = F.regexp_extract(label, _VERSION, 0)
    bare = F.when(
        at > 0,
        F.concat(
            F.substring(label, F.lit(1), at - 1),
            F.substring(label, at + F.length(found), F.length(label)),
        ),
    ).otherwise(label)
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)[\s\-]+", " ")))
