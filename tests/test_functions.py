import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("path", "category"),
    [("tests/a.py", "test"), ("src/a_test.py", "test"), ("docs/x.py", "doc"), ("README", "doc"), ("src/a.py", "code"), ("Makefile", "config"), ("x.toml", "config"), ("x.bin", "other"), ("pkg/foo_test.go", "code"), ("a/tests", "test"), ("a/docs", "doc"), ("Test/x.c", "test")],
)
def test_category(spark, path, category):
    assert one(spark, path, P.category) == category


def test_urls(spark):
    assert one(spark, "https://h/o/r/tree/main", P.normalise_repo_url) == "https://h/o/r"
    assert one(spark, "https://h/o/r/", P.normalise_repo_url) == "https://h/o/r/"
    assert one(spark, "https://h/o/r?tab=x", P.normalise_repo_url) == "https://h/o/r?tab=x"
    assert one(spark, "https://h/o/r/tree/main", P.repo_slug) == ("o", "r")
    assert tuple(one(spark, "https://h/o/r.git", P.repo_slug)) == ("o", "r")


def test_path_parts(spark):
    assert one(spark, "a", P.dirname) == "(root)"
    assert one(spark, "a/b/c.py", P.dirname) == "a/b"
    assert one(spark, "a/b/c.py", P.last_two) == "b/c.py"
    assert one(spark, "c.py", P.last_two) == "c.py"
    assert one(spark, ".env", P.extension) == ""
    assert one(spark, ".github/x.yml", P.is_noise) is True


def python_chunks(text, size):
    import re

    out, cur = [], ""
    for p in re.split(r"\n\s*\n", text):
        if cur and len(cur) + len(p) > size:
            out.append(cur.strip())
            cur = ""
        cur += p + "\n\n"
    return out + ([cur.strip()] if cur.strip() else [])


@pytest.mark.parametrize("text", ["", "\n\n", "a", "a\n\nb", "\n\n".join("x" * n for n in (1000, 600, 100)), "\n \n".join("y" * n for n in (1500, 1, 1499, 1, 3000, 2))])
def test_chunks(spark, text):
    assert one(spark, text, T.chunks) == python_chunks(text, 1500)


def test_chunk_example(spark):
    assert [len(x) for x in one(spark, "\n\n".join("x" * n for n in (1000, 600, 100)), T.chunks)] == [1000, 702]


def test_sentences_and_lines(spark):
    assert one(spark, "One  two. Three.", T.first_sentence) == "One two."
    assert one(spark, None, T.first_sentence) == ""
    assert one(spark, "a\nb\nc", lambda c: T.line_slice(c, F.lit(2), F.lit(3))) == "b\nc"
    assert one(spark, "x\n\nif __name__ == '__main__':", lambda c: T.line_of(c, "if __name__")) == 3
    assert one(spark, "see [1] and [12], not [x]", T.citations) == [1, 12]


@pytest.mark.parametrize(("name", "path", "kind", "role"), [("Cache.get", "a.py", "method", "cache"), ("parse_url", "a.py", "function", "parser"), ("test_f", "a.py", "function", "test"), ("f", "a/tests/x.py", "function", "test"), ("Foo", "a.py", "class", "object")])
def test_roles(spark, name, path, kind, role):
    df = spark.createDataFrame([(name, path, kind)], "n string, p string, k string")
    assert df.select(T.role(F.col("n"), F.col("p"), F.col("k")).alias("r")).first()["r"] == role


def test_signature_and_json(spark):
    assert one(spark, "def f(self, a: int, *b, c=1) -> list[int]", T.parameters) == ["a", "b", "c"]
    assert one(spark, "def f(a) -> int", T.return_type) == "int"
    assert one(spark, 'Sure:\n```json\n{"a": {"b": 1}}\n```', T.json_object) == '{"a": {"b": 1}}'
    assert one(spark, "nothing", T.json_object) is None


def test_salvage():
    cut = '{"scenario": "s", "steps": [{"a": 1}, {"b": "}"}, {"c": '
    assert T.salvage_json(cut) == {"scenario": "s", "steps": [{"a": 1}, {"b": "}"}]}
    assert T.salvage_json("no steps") is None
