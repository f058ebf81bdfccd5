from collections import Counter

from ledgerloom.llm import token_counts as t


def slow(text):
    """Token by token, byte by byte."""
    coder, _ = t.encoder(t.Vocabulary().read(), t.PATTERN)
    text = text or ""
    owner, borders, at = [], [], 0
    for line in text.split("\n"):
        raw = (line + "\n").encode()
        if at == len(text.encode()):
            break
        raw = raw[: len(text.encode()) - at]
        owner += [len(borders)] * len(raw)
        at += len(raw)
        borders.append(at)
    tokens, cross, counts, at = coder.encode_ordinary(text), 0, Counter(), 0
    for k in tokens:
        n = len(coder.decode_single_token_bytes(k))
        own = Counter(owner[at : at + n])
        cross += len(own) > 1
        counts[max(own, key=lambda s: (own[s], -s))] += 1
        at += n
    assert at == len(text.encode())
    chars = [len(text.encode()[:b].decode()) for b in borders]
    return len(tokens), len(borders), cross, [(a, b, counts[i]) for i, (a, b) in enumerate(zip([0, *chars], chars))]


def compare(df):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_sections"], r["n_crossing"], [tuple(s) for s in r["sections"]]) for r in t.apply(df).collect()), key=str)
    assert got == sorted(((r[0], *slow(r[1])) for r in df.select("doc_id", "text").collect()), key=str)
    return got


def test_table(documents):
    compare(documents)


def test_odd(spark, odd, none):
    compare(odd)
    assert t.apply(none).count() == 0
    rows = [(1, "a  \n\n   b\n\n\n  c \n\tif x:\r\n\r\n  y"), (2, "\n"), (3, "漢\n字\n\U0001f600\n"), (4, "end\n\n")]
    assert any(r[3] for r in compare(spark.createDataFrame(rows, "doc_id bigint, text string")))
