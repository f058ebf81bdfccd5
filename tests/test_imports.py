"""Files read by ranges against Python's reader over whole files, and imports as one path."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import contract, delimited, imports, ranges


@pytest.fixture
def small_ranges(spark):
    """Ranges of few bytes, so that records cross many borders."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


def whole(raw, limits, delimiter=","):
    """Failure, header and rows of Python's reader over a file's whole bytes."""
    return delimited.parse(raw, delimiter, limits)


def compare(spark, folder, files, limits, delimiter=","):
    for name, raw in files.items():
        (folder / name).write_bytes(raw)
    got = ranges.scan(spark, str(folder), delimiter, limits)
    held = {r["path"].rsplit("/", 1)[1]: r for r in got.files.collect()}
    rows = {}
    for r in got.rows.collect():
        rows.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["row_number"], list(r["cells"])))
    assert set(held) == set(files)
    for name, raw in files.items():
        failure, header, want = whole(raw, limits, delimiter)
        assert held[name]["failure"] == failure, (name, raw)
        assert sorted(rows.get(name, [])) == [(i + 2, r) for i, r in enumerate(want)], (name, raw)
        if not failure:
            assert list(held[name]["header"]) == header and held[name]["n_rows"] == len(want)
    return held


def test_records_across_ranges(spark, tmp_path, small_ranges):
    """Random cells of quotes, line ends of all kinds, delimiters and marks, some of them broken, in ranges of 16 and of 61 bytes."""
    rng, limits = random.Random(5), delimited.Limits(most_columns=6, most_characters=40)
    parts = ["a", '"', "\n", "\r\n", ",", "é", "x y", "", "\r"]
    for size in (16, 61):
        files = {}
        for i in range(12):
            out = io.StringIO(newline="")
            writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n", "\r"]))
            writer.writerow(["id", "text"])
            for k in range(rng.randint(1, 12)):
                writer.writerow([k, *["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 3))]])
            raw = out.getvalue().encode()
            if i % 3 == 2:  # broken anywhere: a byte is left out
                at = rng.randrange(len(raw))
                raw = raw[:at] + raw[at + 1 :]
            files[f"{i}.csv"] = (b"\xef\xbb\xbf" if i % 4 == 1 else b"") + raw
        folder = tmp_path / str(size)
        folder.mkdir()
        small_ranges(size)
        compare(spark, folder, files, limits)


def test_failures_of_files(spark, tmp_path, small_ranges):
    small_ranges(64)
    limits = delimited.Limits(most_bytes=3000, most_rows=5, most_columns=3, most_characters=20)
    files = {
        "plain": b'x,y\n1,"a\nb"\n\n2\n3,,z\n', "encoding": b"x\n\xff\n", "mark": b"\xef\xbb\xbf\n", "open": b'x\n"open', "open-long": b'x\n"' + b"a\n" * 100, "rows": b"x\n" + b"1\n" * 6, "most-rows": b"x\n" + b"1\n" * 5,
        "columns": b"x\n1,2,3,4\n", "field": b"x\n" + b"f" * 21 + b"\n", "most-field": b"x\n" + "é".encode() * 20 + b"\n", "quoted-field": b'x\n"' + b"a\n" * 11 + b'"\n', "after": b'x\n"a"b\n', "inner": b'x\na"b,c\n', "no-end": b"x\n1",
        "both": b"x\n" + b"1,2,3,4\n" * 9, "blank": b"\n\nx\n",
    }
    held = compare(spark, tmp_path, files, limits)
    assert {r["failure"] for r in held.values()} == {None, *ranges.FAILURES[1:]}
    assert held["plain"]["n_columns"] == 3 and held["plain"]["sha256"] and held["plain"]["n_bytes"] == len(files["plain"])
    (tmp_path / "large").write_bytes(b"x\n" + b"1\n" * 3000)
    (tmp_path / "long-line").write_bytes(b"x\n" + b"1" * 1500 + b"\n")
    more = {r["path"].rsplit("/", 1)[1]: r for r in ranges.scan(spark, str(tmp_path), limits=limits).files.collect()}
    assert (more["large"]["failure"], more["large"]["sha256"], more["long-line"]["failure"]) == ("TOO_LARGE", None, "FIELD_TOO_LONG")
    with pytest.raises(ValueError):
        ranges.scan(spark, str(tmp_path), "|")
    folder = tmp_path / "tabs"
    folder.mkdir()
    compare(spark, folder, {"t": b'x\ty\n"1\n2"\t,\n', "u": b'x;y\n1;"2;3"\n'}, limits, "\t")


HEAD = "trade_id,traded_at,instrument,side,quantity,price,gross_amount,state"


def test_import_as_one_path(spark, tmp_path, small_ranges):
    """Each code of files, headers and rows through one function; columns in another order; a key in two files."""
    small_ranges(100)
    row = lambda k, **c: ",".join({"trade_id": k, "traded_at": "2026-09-07T12:00:00Z", "instrument": "BTC", "side": "BUY", "quantity": "2", "price": "1", "gross_amount": "2", "state": "SETTLED", **c}.values())
    files = {
        "good": "\n".join([HEAD, row("a"), row("b", quantity="NaN"), row("twice"), row("twice", side="HOLD"), row("c") + ",more,", "d", "", row("e", instrument='"B\nTC"'), row("f", instrument="-"), row("g", instrument=" ")]),
        "again": "\n".join([HEAD, row("a")]), "turned": "\n".join(["note,state,gross_amount,price,quantity,side,instrument,traded_at,trade_id", 'x,SETTLED,2,1,2,SELL,ETH,2026-09-07T12:00:00Z,"t"']),
        "double": "\n".join([f"{HEAD},side,,", row("h")]), "lacks": "\n".join([HEAD.replace(",price", ",cost"), row("i")]), "header-only": HEAD, "broken": f'{HEAD}\n"x"y', "bytes": HEAD + "\n\udcff",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode("utf-8", "surrogateescape"))
    held = contract.Contract(**{**contract.ledger().__dict__, "null_tokens": ("-",)})
    got = imports.read(spark, str(tmp_path), held)
    name = lambda r: r["path"].rsplit("/", 1)[1]
    states = {name(r): (r["state"], r["failure"], ",".join(r["header_issues"]), r["n_rows"], r["n_issues"], r["n_bad"], r["n_eligible"]) for r in got.files.collect()}
    lacking = ",".join(f"{c}:MISSING_VALUE" for c in ("executed_at", "gross_amount", "instrument", "quantity", "side", "state", "unit_price"))
    want = {
        2: ("a", ""), 3: ("b", "quantity:NON_FINITE_DECIMAL"), 4: ("twice", "source_record_key:DUPLICATE_SOURCE_KEY"), 5: ("twice", "side:UNKNOWN_ENUM,source_record_key:DUPLICATE_SOURCE_KEY"), 6: ("c", "_row:UNEXPECTED_COLUMN"), 7: ("d", lacking),
        8: (None, ",".join(sorted([*lacking.split(","), "source_record_key:MISSING_VALUE"]))), 9: ("e", ""), 10: ("f", "instrument:NULL_VALUE"), 11: ("g", "instrument:EMPTY_VALUE"),
    }
    rows = {(name(r), r["row_number"]): r for r in got.rows.collect()}
    assert {k[1]: (r["source_record_key"], ",".join(r["issues"])) for k, r in rows.items() if k[0] == "good"} == want
    n_issues = sum(len(codes.split(",")) for _, codes in want.values() if codes)
    assert states == {
        "good": ("READ", None, "", 10, n_issues, 8, 2), "again": ("READ", None, "", 1, 0, 0, 1), "turned": ("READ", None, "", 1, 0, 0, 1), "header-only": ("READ", None, "", 0, 0, 0, 0),
        "double": ("BLOCKED", None, "_header:DUPLICATE_HEADER,side:DUPLICATE_HEADER", 1, 2, 0, 0), "lacks": ("BLOCKED", None, "price:MISSING_COLUMN", 1, 1, 0, 0),
        "broken": ("QUARANTINED", "MALFORMED_CSV", "", None, 0, 0, 0), "bytes": ("QUARANTINED", "INVALID_ENCODING", "", None, 0, 0, 0),
    }
    assert {k[0] for k in rows} == {"good", "again", "turned", "double", "lacks"}
    blocked = rows["lacks", 2]
    assert (blocked["source_record_key"], blocked["issues"], blocked["eligible"], blocked["raw"][0]["original"]) == (None, [], False, "i")
    kinds = lambda n: [(c["column"], c["kind"], c["original"]) for c in rows["good", n]["raw"]]
    assert kinds(6)[7:] == [("state", "VALUE", "SETTLED"), ("__extra_1", "VALUE", "more"), ("__extra_2", "EMPTY", "")] and kinds(7)[:2] == [("trade_id", "VALUE", "d"), ("traded_at", "MISSING", None)]
    assert kinds(10)[2] == ("instrument", "NULL", "-") and kinds(11)[2] == ("instrument", "EMPTY", " ") and kinds(9)[2] == ("instrument", "VALUE", "B\nTC")
    assert (rows["turned", 2]["source_record_key"], rows["turned", 2]["side"], rows["turned", 2]["instrument"]) == ("t", "SELL", "ETH")
    back = {(name(r), r["row_number"]): list(r["cells"]) for r in got.rows.select("path", "row_number", imports.original(F.col("raw")).alias("cells")).collect()}
    for f in ("good", "double"):
        assert [back[f, i + 2] for i in range(len(back)) if (f, i + 2) in back] == list(csv.reader(io.StringIO(files[f], newline="")))[1:]
