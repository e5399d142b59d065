import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V


def value(spark, column, **inputs):
    names = list(inputs)
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in inputs.items()))
    assert names
    return row.select(column.alias("v")).collect()[0]["v"]


def keywords(text, limit=25):
    """By hand, from the rules."""
    out = []
    for raw in re.findall(r"[A-Za-z0-9_./\\-]+", text or ""):
        token = raw.strip("._-/\\")
        if not token:
            continue
        parts = [p for p in re.split(r"[_\-./\\]+", token) if p]
        mixed = token not in (token.lower(), token.upper())
        for k in ([token] if len(parts) > 1 or mixed else []) + [x for p in parts for x in [p, *re.findall(r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|\d+", p)]]:
            k = k.lower()
            if len(k) > 1 and not k.isdigit() and k not in V.STOP_WORDS and k not in out:
                out.append(k)
    return out[:limit]


TEXTS = ["src/summary_router.py routes CI/CD jobs", "camelCase HTTPServer2Go snake_case a-b", "", None, "the of and 12 345 x", "--.__ //", "A.B.C parseXMLFile v1.2.3", "É mañana straße"]


@pytest.mark.parametrize("text", TEXTS)
def test_keywords(spark, text):
    assert value(spark, T.keywords(F.col("t")), t=text) == keywords(text)
    assert value(spark, T.keywords(F.col("t"), 2), t=text) == keywords(text, 2)


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.slug, "  Hello, World! ", "hello-world"),
        (T.slug, "***", "section"),
        (T.normal_heading, " Title : – ", "title"),
        (T.numbering_prefix, "2.1 Scope", "2.1"),
        (T.numbering_prefix, "1999 was", None),
        (T.numbering_prefix, "3) item", "3"),
        (T.sentence_count, "1. Intro. See 2.1 now. Done", 3),
        (T.sentence_count, "", 0),
        (T.sentence_count, "...", 1),
        (T.ends_with_colon, "Note:–  ", True),
        (T.ends_with_full_stop, "End. ", True),
        (T.ends_with_full_stop, "End.:", False),
        (T.is_title_case, "The Art of War", True),
        (T.is_title_case, "the of", False),
        (T.is_all_caps, "ÀB 12", True),
        (T.is_all_caps, "12", False),
        (T.note_or_link, "NOTE - x", "note"),
        (T.note_or_link, "Notes: x", None),
        (T.file_stem, "a/b/c.tar.gz", "c.tar"),
        (T.file_stem, "a/.env", ".env"),
        (T.extension, "a/b.PY", "py"),
        (T.extension, "Makefile", None),
        (T.path_categories, "tests/security/test_x.py", ["limitations_risks", "testing"]),
        (T.path_categories, ".github/workflows/a.yml", ["ci_deployment"]),
        (T.path_categories, "README.md", ["documentation", "overview"]),
        (T.path_categories, "src/change_router.py", ["automation_pipeline"]),
        (T.path_categories, "src/core.py", ["architecture_modules"]),
        (T.path_categories, "", []),
        (T.categories, "We deploy with GitHub Actions and pytest", ["ci_deployment", "testing"]),
        (T.redacted, "token=abc and Bearer xyz.1", "[redacted] and [redacted]"),
        (T.is_inventory_item, "- `src/foo.py`", True),
        (T.is_inventory_item, "- The router in src/foo.py picks one", False),
        (T.is_inventory_block, "1. `src/module.py`.", True),
        (T.is_inventory_block, "- `pytest` runs it", False),
        (T.without_fences, "a\n```\nb\n~~~\nc", "a\nc"),
        (T.without_regions, "a\nx UPDATE_START UPDATE_END\nb\nUPDATE_END\nc", "a\nc"),
        (T.direct_content, "a\n| t |\n- x.py\n<!-- n\nm -->z", "a\n z"),
        (T.content_hash, "  \n", None),
    ],
)
def test_functions(spark, function, text, want):
    assert value(spark, function(F.col("t")), t=text) == want


@pytest.mark.parametrize(("n", "letters", "roman"), [(0, "", ""), (1, "a", "i"), (26, "z", "xxvi"), (27, "aa", "xxvii"), (703, "aaa", "dcciii"), (1994, "bxr", "mcmxciv")])
def test_numerals(spark, n, letters, roman):
    assert value(spark, T.letters_of(F.col("n")), n=n) == letters and value(spark, T.roman_of(F.col("n")), n=n) == roman
