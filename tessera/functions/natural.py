"""Natural order of strings as sort keys: runs of text and numbers compare as text and as numbers.

Nulls and odd values: a null string has a null key (Spark sorts it first); digits of any number compare exactly; equal numbers written differently
(007 and 7) are ties; an empty string has an empty key and comes first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of numbers: their pattern. Those of digits alone compare exactly, the others as doubles.
FORMS = {"digits": "[0-9]+", "signed": r"[-+]?[0-9]+", "decimal": r"[-+]?[0-9]*\.?[0-9]+", "exponent": r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|NaN|[-+]?Inf", "hex": "0[xX][0-9a-fA-F]+", "binary": "0[bB][01]+"}
#: Greater than any character of a text.
LAST = "\U0010ffff"


def natural_key(s: Column, *, match_case: bool = False, pattern: str | None = None, form: str = "digits", numbers_first: bool = True, nan_first: bool = False) -> Column:
    """array<struct<t, has, size, digits, n>>: Spark orders it run by run, and desc() turns the order round.

    t is the text before a number and has is 0 in a run without one, so that it comes first. A whole number is (size, digits) without leading zeros;
    other forms are n. numbers_first: a number sorts before any character that stands in its place, else after. nan_first: NaN before all numbers."""
    if form not in FORMS:
        raise ValueError(f"unknown form of numbers {form!r}; there are {', '.join(FORMS)}")
    if pattern is not None and form != "digits":
        raise ValueError("give a pattern of digits or a form, not both")
    number = FORMS[form] if pattern is None else pattern
    text = s if match_case or form in ("exponent", "hex", "binary") else F.lower(s)
    runs = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{number})|.+$"), F.lit(0))

    def run(x: Column) -> Column:
        last = F.regexp_extract(x, f"({number})$", 1)
        # the shortest text before a number that ends the run
        before = F.regexp_extract(x, rf"^((?s).*?)(?:{number})$", 1) if form != "digits" else F.regexp_replace(x, f"(?:{number})$", "")
        has = last != ""
        before = F.when(has, before).otherwise(x)
        before = before if match_case or form not in ("exponent", "hex", "binary") else F.lower(before)
        plain = F.regexp_replace(last, "^0+(?=.)", "")
        value = F.lit(0.0)
        if form in ("signed", "decimal", "exponent"):
            lower = F.lower(last)
            value = F.when(lower == "nan", F.lit(float("-inf") if nan_first else float("nan"))).when(lower.endswith("inf"), F.when(lower.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.expr("1.0D") * last.try_cast("double"))
            plain = F.lit("")
        elif form in ("hex", "binary"):
            plain = F.regexp_replace(F.lower(F.substring(last, 3, 1 << 30)), "^0+(?=.)", "")
        none = ~has
        return F.struct(
            (before if numbers_first else F.when(has, F.concat(before, F.lit(LAST))).otherwise(before)).alias("t"), has.cast("int").alias("has"),
            F.when(none, 0).otherwise(F.length(plain)).alias("size"), F.when(none, "").otherwise(plain).alias("digits"), F.when(none, 0.0).otherwise(value).alias("n"),
        )

    return F.transform(runs, run)


def path_key(path: Column) -> Column:
    """struct of keys: extension, then name, then directories from the deepest to the root."""
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    ext = F.regexp_extract(file, r"(\.[^.]*)$", 1)
    name = F.regexp_replace(file, r"\.[^.]*$", "")
    dirs = F.reverse(F.slice(parts, F.lit(1), F.size(parts) - 1))
    return F.struct(natural_key(ext).alias("ext"), natural_key(name).alias("name"), F.transform(dirs, lambda d: natural_key(d)).alias("dirs"))


def shown(key: Column) -> Column:
    """The parsed runs of a key as text: text:number|text:number, with - for no number."""
    return F.array_join(F.transform(key, lambda x: F.concat_ws(":", x["t"], F.when(x["has"] == 0, F.lit("-")).when(x["size"] > 0, x["digits"]).otherwise(F.format_number(x["n"], 3)))), "|")
