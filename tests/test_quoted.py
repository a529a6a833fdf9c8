import contextlib
import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limpid.sources import delimited, quoted

FIELDS = ["", "a", "b c", 'say ""hi""', "x\ny", '\n', ",", '""', "1", "long " * 5, 'q""\n', "\r\n", "é\nñ"]


def content(seed, rows=40, sep=","):
    """Records with quoted and plain fields, line breaks and doubled quotes inside, literal quotes outside."""
    r = random.Random(seed)

    def field():
        f = r.choice(FIELDS)
        if sep in f or "\n" in f or '"' in f or r.random() < 0.3:
            return f'"{f}"' + r.choice(["", "", "", "x", 'y"z'])
        return f + r.choice(["", "", '"', 'p"q']) if f else f

    return "k,u,v,w\n".replace(",", sep) + "".join(sep.join([str(i), field(), field(), field()]) + "\n" for i in range(rows))


@contextlib.contextmanager
def small_splits(spark, size):
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    kept = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(size))
    spark.conf.set(names[1], "1")
    try:
        yield
    finally:
        for n, v in zip(names, kept):
            spark.conf.set(n, v)


def plain(text):
    """The cells as the csv module reads them; empty plain cells are missing, empty quoted ones are too after cleaning."""
    return [tuple(c or None for c in r) for r in csv.reader(io.StringIO(text, newline=""))][1:]


def judged(spark, lines, sep=","):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    return np.array([r["c"] for r in frame.select("i", quoted.Grammar(sep).code(F.col("s")).alias("c")).orderBy("i").collect()], np.int8)


@pytest.mark.parametrize("seed", range(3))
def test_every_cut_between_lines(spark, seed):
    """All pairs of cuts: the pieces meet in the records that one scan of the whole text gives."""
    text = content(seed, 14)
    lines = text.split("\n")[:-1]
    codes = judged(spark, lines)
    want, held = [], []
    for line, inside in zip(lines, quoted.states(codes, 0)[1:]):
        held.append(line)
        if not inside:
            want.append("\n".join(held))
            held = []
    assert not held and len(want) == len(plain(text)) + 1
    cells = [next(csv.reader(io.StringIO(w, newline=""))) for w in want]
    assert [tuple(c or None for c in r) for r in cells[1:]] == plain(text)
    values = pa.array([s.encode() for s in lines], pa.binary())
    for a in range(len(lines) + 1):
        for b in range(a, len(lines) + 1, 3):
            state, pieces = 0, []
            for lo, hi in ((0, a), (a, b), (b, len(lines))):
                if lo == hi:
                    continue
                effects = [int(quoted.states(codes[lo:hi], e)[-1]) for e in (0, 1)]
                split, out = quoted._Split(state), []
                middle = (lo + hi) // 2  # and a batch border inside the split
                split.take(codes[lo:middle], values.slice(lo, middle - lo), out)
                split.take(codes[middle:hi], values.slice(middle, hi - middle), out)
                split.finish(out)
                pieces += [(lo + int(x), kind, v) for at, kind, vs in out for x, v in zip(at, vs.to_pylist())]
                state = effects[state]
            found = {}
            for row, kind, v in sorted(pieces, key=lambda p: (p[0], -p[1])):
                if kind == quoted.CARRIED:
                    found[max(found)] += b"\n" + v
                else:
                    found[row] = v
            assert [found[k].decode() for k in sorted(found)] == want


@pytest.mark.parametrize("size", [40, 150, 10**6])
def test_splits_of_any_size(spark, tmp_path, size):
    text = content(9, 30)  # about 700 bytes
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_bytes(("w;x\n").replace(";", ",").encode() + b"plain,1\n")
    with small_splits(spark, size):
        table = delimited.read_csv(spark, str(tmp_path), infer=False, position=True)
        got = delimited.number_rows(table).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(31))
    assert [(r["k"], r["u"], r["v"], r["w"]) for r in got[:30]] == plain(text) and (got[30]["w"], got[30]["x"]) == ("plain", "1")


def test_encodings_separators_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('"Año\nuno";n\r\n"é\r\nñ";1\r\n\r\n"x;y";2\r\n'.encode("latin-1"))
    got = delimited.read_csv(spark, str(tmp_path / "a.csv"), sep=";").orderBy("n").collect()
    assert [tuple(r) for r in got] == [("é\r\nñ", 1), ("x;y", 2)] and got[0].__fields__ == ["a_o_uno", "n"]
    odd = tmp_path / "odd [1] name"
    odd.mkdir()
    (odd / "p{1}.csv").write_text('a,b\n"1\n2",3\n')
    (odd / "q.csv").write_text("﻿b,a\n5,6\n")
    assert sorted(tuple(r) for r in delimited.read_csv(spark, str(tmp_path / "odd*"), infer=False).select("a", "b").collect()) == [("1\n2", "3"), ("6", "5")]


def test_a_quote_that_is_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"1,2\n3,4\n')
    with pytest.raises(ValueError, match="never closed"):
        delimited.read_csv(spark, str(tmp_path / "a.csv"))


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,t\n" + "".join(f'{i},"line {i}\nnext ""{i}"""\n' for i in range(20_000)))
    with small_splits(spark, 30_000):
        lines = quoted.raw_lines(spark, [(tmp_path / "a.csv").as_uri().replace("file:///", "file:/")], quoted.Grammar(","))
        assert lines.rdd.getNumPartitions() >= 8
        table = delimited.read_csv(spark, str(tmp_path / "a.csv"), position=True)
        got = delimited.number_rows(table, "at")
        assert got.where("k <> at or t <> concat('line ', k, '\n', 'next \"', k, '\"')").count() == 0 and got.count() == 20_000
