"""Names of windows, nodes and entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label codes, anything else is normal; and the field widths of contexts and evidence.
LABEL_CODES = {"purchase": 0, "signup": 1, "error": 2, "view": 3, "click": 4}
NORMAL_CODE = 6


def label_code(label: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in LABEL_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, label), F.lit(NORMAL_CODE))


def content(node_id: Column) -> Column:
    """What follows the type of a node id; an id without a type is its own content."""
    return F.regexp_replace(node_id, r"^[^:]*:", "")


def with_prefix(wid: Column, prefix: str = "Window:") -> Column:
    return F.when(wid.startswith(prefix), wid).otherwise(F.concat(F.lit(prefix), wid))


def short_id(wid: Column, most: int = 80) -> Column:
    return F.substring(F.translate(wid, ":/", "__"), 1, most)


def is_semantic(node_id: Column) -> Column:
    """Whether a node is a general entity that is a word of its own: no key with a value. Other types never are."""
    return node_id.startswith("GeneralEntity:") & ~content(node_id).rlike("[:=]")


def text_or_template(raw_line: Column, template: Column) -> Column:
    return F.coalesce(F.nullif(raw_line, F.lit("")), template)


#: How a report begins that no generator wrote.
STUB = "[stub report]"


def stub_report(prompt: Column) -> Column:
    """What stands for a generated report where no generator is set."""
    return F.concat(F.lit(STUB + " prompt of "), F.length(prompt).cast("string"), F.lit(" characters"))
