import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity, text, vectors
from tidemark.functions.times import neutral

SPACE = r"[\s\x1c-\x1f\x85]"
TEXTS = [
    "---\ntitle: A b\n---\nBody  \n\n\n\nmore {{% x\ny %}} <b>t</b> a < b and c > d\n", "---\n---\nno block\n", "--- \nx\n---\n", "", " ", "a\r\nb\r\n", "  edge  \x1c", "{{< a >}}{{< b >}}",
    "---\nx: 1\n---\n---\ny: 2\n---\nz", "no end\n---\n", "<https://x.y> z", "tab\t\n\n \n\nend", "{{ plain }} <a\nhref>q</a>",
]


def clean(t):
    """The cleaning rules on a plain string."""
    t = re.sub(r"\r\n?", "\n", t)
    m = re.match(r"\A---\n(.*?)\n---\n", t, re.DOTALL)
    t = t[m.end() :] if m else t
    t = re.sub(r"<[^>]+>", "", re.sub(r"\{\{[%<]\s*.*?\s*[%>]\}\}", "", t, flags=re.DOTALL))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip() + "\n"


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


@pytest.mark.parametrize("t", TEXTS)
def test_clean_body_and_words(spark, t):
    r = one(spark, t, text.clean_body(F.col("x")).alias("b"), text.word_count(F.col("x")).alias("n"), text.is_stub(F.col("x")).alias("s"))
    assert r.b == clean(t) and r.n == len(t.split()) and r.s == (len(t.split()) < 30)


def test_titles_and_paths(spark):
    cases = [("---\ntitle: \"Q x\"\n---\nb", "a/b.md", "Q x"), ("---\ntitle:\n---\nb", "a/b.md", "b"), ("b", "a/some.name.md", "some.name"), ("b", "plain", "plain"), ("---\nsub: 1\ntitle: T\n---\n", "a", "T")]
    df = spark.createDataFrame([(t, p) for t, p, _ in cases], "t string, p string")
    assert [r[0] for r in df.select(text.title_of(F.col("t"), F.col("p"))).collect()] == [w for _, _, w in cases]
    paths = {"content/handbook/a/b.md": "a/b", "/srv/x/content/handbook/a.b/c.d.md": "a.b/c.d", "content/handbook/x": "x", "other/y.md": "other/y"}
    assert {p: one(spark, p, text.doc_id_of(F.col("x")))[0] for p in paths} == paths


def test_units(spark):
    r = one(spark, "A b.  C d!\n \nE? f.g\n\n\n \n", text.paragraphs(F.col("x")).alias("p"), text.sentences(F.lit("A b.  C d! E? f.g ")).alias("s"))
    assert r.p == ["A b.  C d!", "E? f.g"] and r.s == ["A b.", "C d!", "E?", "f.g "]


def test_identities(spark):
    keys = [f"doc/{i}é" for i in range(200)] + [""]
    df = spark.createDataFrame([(k,) for k in keys], "x string")
    rows = df.select("x", identity.hash_bucket(F.col("x"), "salt").alias("b"), identity.uuid5(F.col("x")).alias("u"), identity.in_bucket(F.col("x"), "salt").alias("i")).collect()
    for r in rows:
        n = int(hashlib.sha256(f"salt:{r.x}".encode()).hexdigest(), 16) % 100
        assert r.b == n and r.i == (n < 50) and r.u == str(uuid.uuid5(uuid.UUID(identity.POINT_NAMESPACE), r.x))
    r = one(spark, "d", identity.chunk_id(F.col("x"), F.lit(7), F.lit(3)).alias("c"), identity.deletion_marker(F.col("x"), F.lit("s")).alias("m"), identity.rename_marker(F.col("x"), F.lit("e"), F.lit("s")).alias("n"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (r.c, r.m, r.n) == ("d::v7::0003", sha("DELETED:d:s"), sha("RENAMED:d->e:s"))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.norm(F.col("a")).alias("n"), vectors.parse_vector(vectors.vector_literal(F.col("a"))).alias("p"), "a").collect()
    assert [r.c for r in rows] == [1.0, 0.0, None, None, None] and rows[0].n == 5.0
    assert all(r.p == r.a for r in rows if r.a)


def test_neutral_spelling(spark):
    values = [" Live\t", "LIVE", "", "  ", None, "de-leted "]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert [r[0] for r in df.select(neutral("x")).collect()] == ["live", "live", None, None, None, "de-leted"]
