import random
import re
from collections import Counter

from ledgerloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """Straight from the definition."""
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def compare(df, q_rows):
    want = Counter((r["doc_id"], *base(r["text"])) for r in df.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], *(r[n] for n in NAMES)) for r in q_rows) == want


def test_base_measures(documents):
    rows = q.apply(documents).collect()
    compare(documents, rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_odd_rows(odd, none):
    compare(odd, q.apply(odd).collect())
    assert q.apply(none).count() == 0


def _corpus(copies):
    """Thirty hosts' worth of texts of which many share a footer, and copies of one text."""
    footer = "\n".join(f"footer line number {'abcdefgh'[k]} of this very site here" for k in range(8))
    body = lambda i: "\n".join(" ".join(f"t{i}w{j}q{k}" for k in range(9)) for j in range(12))
    short = lambda i: " ".join(f"s{i}w{k}" for k in range(9))
    rows = [(i, body(i), "h") for i in range(60)]
    rows += [(100 + i, short(i) + "\n" + footer, "h") for i in range(40)]
    rows += [(200 + i, body(999) + f"\nonly {i} here", "h") for i in range(copies)]
    return rows


def test_boilerplate_and_copies(spark):
    df = spark.createDataFrame(_corpus(50), "doc_id bigint, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in q.apply(df, q.Rules(least_documents=20)).collect()}
    assert all(kept[i] for i in range(60)), "texts of their own stay"
    assert not any(kept[100 + i] for i in range(40)), "texts that are mostly footer go"
    assert all(kept[200 + i] for i in range(50)), "near copies are no boilerplate"
    salted = q.apply(df, q.Rules(least_documents=20, broadcast_rows=0)).collect()
    assert {r["doc_id"]: r["kept"] for r in salted} == kept


def test_stage_keeps_columns(spark, odd, documents):
    assert q.stage(spark, odd, "").columns == odd.columns
    out = q.stage(spark, documents, "")
    kept = {r["doc_id"] for r in q.apply(documents).where("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept


def test_documents_of_a_line_are_counted(spark):
    """Footers of texts that pass the base rules; lines in any order; texts that are the same but for digits."""
    rng = random.Random(7)
    notice = [" ".join(f"notice{j}x{k}" for k in range(9)) for j in range(8)]
    own = lambda i, n=9: " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}{k}" for k in range(n))
    three = [" ".join(f"{c}{k}" for k in range(20)) for c in ("red", "green", "blue")]
    rows = [(i, "\n".join([own(i), *notice]), "a") for i in range(100)]
    rows += [(200 + i, "\n".join([*rng.sample(three, 3), own(i, 5)]), "b") for i in range(30)]
    rows += [(300 + i, "\n".join(" ".join(f"form{j}{c} {i}" for c in "abcdefgh") for j in range(4)), "c") for i in range(10, 70)]
    rows += [(400 + i, "\n".join([*notice, f"copy {i}"]), "d") for i in range(60)]
    rows += [(500 + i, "\n".join([own(i), *notice]), "e") for i in range(20)]
    out = {r["doc_id"]: r for r in q.apply(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(r["base_failed"] for r in out.values())
    words = lambda low, n: {r["n_boilerplate_words"] for i, r in out.items() if low <= i < low + n}
    assert words(0, 100) == {72} and words(200, 30) == {60} and words(300, 60) == {0} and words(400, 60) == {0} and words(500, 20) == {0}
    assert {i for i, r in out.items() if r["kept"]} == set(range(310, 370)) | set(range(400, 460)) | set(range(500, 520))


def test_stage_with_null_and_repeated_ids(spark):
    """A clean text without an id stays; of one id with two texts only the clean one does."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(80))
    rows = [(None, text("a"), "h"), (None, text("b"), None), (None, "few words", "h"), (1, text("c"), "h"), (1, "few", "h")]
    out = q.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "")
    assert sorted(r["text"][:2] for r in out.collect()) == ["a0", "b0", "c0"]
