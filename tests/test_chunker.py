import random
import re

from tidemark.operators.chunker import TOKEN, chunk


def tokens(t):
    return len(re.findall(TOKEN, t))


def model(text, most, overlap):
    """A plain walk over the same units."""
    found = []
    for p in (p for p in re.split(r"\n\s*\n", text) if p.strip()):
        if tokens(p) <= most:
            found.append(p)
            continue
        for s in (s for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()):
            if tokens(s) <= most:
                found.append(s)
            else:
                t = re.findall(rf"(?:{TOKEN})[ \t\r\n]*", s)
                found += ["".join(t[k : k + most]).rstrip(" ") for k in range(0, len(t), most)]
    size, out, i = [tokens(u) for u in found], [], 0
    while i < len(found):
        j = i + 1
        while j < len(found) and sum(size[i : j + 1]) <= most:
            j += 1
        out.append("\n\n".join(found[i:j]))
        if j == len(found):
            break
        held, b = 0, j
        while b - 1 > i and held < overlap:
            b -= 1
            held += size[b]
        i = b
    return out


def test_matches_a_plain_walk(spark):
    rng = random.Random(4)
    def text():
        paras = []
        for _ in range(rng.randint(0, 14)):
            paras.append(" ".join("word" * rng.randint(1, 2) + rng.choice([" ", " ", ". ", "! "]) for _ in range(rng.choice([1, 5, 20, 60]))))
        return "\n\n".join(paras)

    texts = [text() for _ in range(60)] + ["", " \n\n ", None, "x " * 500, "a\n\n\n\nb", "w " * 10 + "\n\n" + "v " * 45 + "\n\n" + "u " * 50]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id bigint, text string, ordinal string")
    for most, overlap in ((50, 8), (30, 0), (12, 12)):
        got = {}
        for r in sorted(chunk(df, "id", "text", most, overlap).collect(), key=lambda r: (r.id, r.ordinal)):
            got.setdefault(r.id, []).append(r.text)
            assert r.token_count == tokens(r.text)
        for i, t in enumerate(texts):
            assert got.get(i, []) == (model(t, most, overlap) if t else []), i


def test_a_window_of_overlap_alone_is_kept(spark):
    text = "\n\n".join("w " * n for n in (50, 450, 500))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = sorted(chunk(df, "id", "text").collect(), key=lambda r: r.ordinal)
    assert [r.token_count for r in rows] == [500, 450, 500]


def test_any_columns_may_be_asked_for(spark):
    df = chunk(spark.createDataFrame([(1, "a b. " * 600), (2, None)], "id int, text string"), "id", "text")
    assert df.count() == df.select("ordinal").count() == len(df.collect()) == df.where("token_count > 0").count() > 1
