"""Token files, fill-in-the-middle and conversation repair against plain versions of the same work."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import conversations as cv
from ledgerloom.llm import fill_middle, queries, token_files
from ledgerloom.llm.common import new_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, n long, form string, output string, part int, seq long, h1 long"
TURN = "conv_id bigint, turn bigint, role string, text string, part int, whole boolean, audit string, _row long"


def docs(spark, rows):
    """rows of (doc_id, text), with columns whose names the operators use themselves"""
    return spark.createDataFrame([(i, t, None, "x", "y", 1, 2, 3) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


ODD = [(None, None), (None, "a b"), (None, "a b"), (-7, ""), (-7, ""), (-7, "other"), (10**12, "x" * 300_000), (10**12 + 1, "é😀 " * 9_000)]


# --- token files


@pytest.mark.parametrize("high", [1, 2, 300, 49_408, 2**32])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_shards_give_back_every_range(high, share):
    rng = np.random.default_rng(high % 1000)
    for n in (0, 1, 255, 256, 257, 9_000):
        ids = rng.integers(0, high, n, dtype=np.uint32)
        ids[:300] = min(7, high - 1)
        ids[rng.integers(0, n, n // 30)] = high - 1
        lengths = np.array([n // 3, 0, n - n // 3])
        shard = token_files.Shard(token_files.encode_shard(ids, lengths, share=share))
        assert (shard.ids() == ids).all() and len(shard.ids()) == n and (shard.lengths == lengths).all()
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (shard.ids(a, b) == ids[a:b]).all() and shard.crc32(a, b) == zlib.crc32(ids[a:b].astype("<u4").tobytes())


def test_shards_of_several_slices(monkeypatch):
    monkeypatch.setattr(token_files, "SHARD", 1024)
    ids = np.random.default_rng(1).integers(0, 70_000, 5_000, dtype=np.uint32)
    shard = token_files.Shard(token_files.encode_shard(ids, np.array([5_000])))
    assert (shard.ids() == ids).all() and (shard.ids(1_000, 3_333) == ids[1_000:3_333]).all()
    assert shard.crc32(7, 4_999) == zlib.crc32(ids[7:4_999].astype("<u4").tobytes())


def test_spoilt_shards_are_refused():
    data = token_files.encode_shard(np.arange(1_000, dtype=np.uint32), np.array([1_000]))
    for bad in (b"JUNK" + data[4:], data[:-1], data + b"x"):
        with pytest.raises(ValueError):
            token_files.Shard(bad)


def test_few_outliers_cost_few_bytes():
    ids = np.full(25_600, 5, np.uint32)
    ids[::256] = 40_000
    assert len(token_files.encode_shard(ids, np.array([25_600]))) < 100 * (token_files.INDEX.itemsize + 3) + 100


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_token_files(spark, corpus, tmp_path, shard):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    library, rows = Tokenizer.from_file(path), corpus + ODD
    where = new_path(spark, "tokens")
    token_files.write(docs(spark, rows).repartition(5), where, path, shard=shard)
    shards = token_files.read(spark, where)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.documents(shards).collect())
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    assert [g[1] for g in got] == [None] * 3 + sorted(i for i, _ in rows if i is not None)
    found = {}
    for _, i, n, crc in got:
        found.setdefault(i, []).append((n, crc))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()}
    if shard == 50:
        assert shards.count() > 100
    files = token_files.export(shards, f"file://{tmp_path}/files").orderBy("start").collect()
    whole = np.concatenate([token_files.Shard(open(f.path, "rb").read()).ids() for f in files])
    assert len(whole) == sum(n for x in want.values() for n, _ in x) and not list((tmp_path / "files").glob("*.pfor.*"))


def test_token_files_of_nothing(spark):
    where = new_path(spark, "tokens")
    token_files.write(docs(spark, []), where, queries.tokenizer_file("word_bpe_49k.json"))
    assert token_files.documents(token_files.read(spark, where)).count() == 0


# --- fill-in-the-middle


def middle(i, t):
    t = t or ""
    n, d = len(t), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    plain = not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{t[:p]}<S>{t[q:]}<M>{t[p:q]}", "spm": f"<S>{t[q:]}<P>{t[:p]}<M>{t[p:q]}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, n, form, None if plain else p, None if plain else q - p, sha(out), sha(t))


def test_middles(spark, corpus):
    rng, size = random.Random(2), fill_middle.SLICE
    rows = corpus + ODD + [(1, "<P>"), (2, "x" * (size - 1) + "<S>"), (3, "x" * (size - 2) + "<M>y"), (4, "<P<S<M"), (5, "é<" * 600), (6, "a" * (size - 3) + "€€€"), (7, "<" * 999)]
    for i in range(1_500):
        n = rng.choice([0, 1, 2, 5, 100, size - 1, size, size + 1, 1_000])
        rows.append((100 + i, "".join(rng.choice("<PSM>aé€😀\n") if i % 2 else rng.choice("<ab€") for _ in range(n))))
    got = fill_middle.digest_columns(fill_middle.fill_in_middle(docs(spark, rows))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((middle(*r) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs(spark, [])).count() == 0


def test_middles_with_other_sentinels(spark, corpus):
    marks, rows = ("<｜前｜>", "<｜後｜>", "|中"), [(i, f"{t} <｜ |") for i, t in corpus] + [(-1, "a|中b"), (-2, "<｜前｜")]
    made = fill_middle.fill_in_middle(docs(spark, rows), sentinels=marks, plain=0, spm=50)
    again = {r.doc_id: (r.form, r.t) for r in made.select("doc_id", "form", fill_middle.restored(made["output"], made["form"], marks).alias("t")).collect()}
    assert {i: t for i, (_, t) in again.items()} == dict(rows) and again[-1][0] == "plain" and again[-2][0] != "plain"


def test_middles_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    columns = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    want = con.sql(f"SELECT {columns} FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(map(tuple, queries.op12_fill_in_middle(spark, SF).collect())) == sorted(want)


# --- conversations


def repaired(rows):
    """The contract, row by row: for every roles-so-far the least (cost, letters, rows) of all edits."""
    space = lambda x: " " if x is None else str(x)
    talks = {r[0]: [] for r in rows}
    for c, t, r, x in rows:
        h, r, x = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20, space(r), space(x)
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        talks[c] += [(t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    out, role = [], {"u": "user", "a": "assistant"}
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    for c, own in talks.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, hashlib.sha256(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()))
        turns, seen, faults = {z[0] for z in own if z[0] is not None}, set(), []
        for _, r, x in own:
            body = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not body else 2 if (r, x) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((r, x))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))

        def inserted(best):
            for _ in range(3):
                for s, (cost, letters, kept) in list(best.items()):
                    new = (cost + 5, letters + "I", kept + ((role[follows[s]], ""),))
                    if follows[s] not in best or new[:2] < best[follows[s]][:2]:
                        best[follows[s]] = new
            return best

        best = inserted({"": (0, "", ())})
        for (_, r, x), fault in zip(own, faults):
            every = []
            for s, (cost, letters, kept) in best.items():
                every.append((s, (cost + 2, letters + "D", kept)))
                if fault in (0, 3):
                    more, n = 5 * (fault == 3), follows[s]
                    every.append((n, (cost + 1 + more, letters + "R", kept + ((role[n], x),))))
                    if r[:1] == n or (r[:1] == "s" and s == ""):
                        every.append((r[:1], (cost + more, letters + "K", kept + ((r, x),))))
            best = {}
            for s, v in every:
                best[s] = min(v, best.get(s, v), key=lambda z: z[:2])
            best = inserted(best)
        cost, letters, kept = min((best[s] for s in ("", "a") if s in best), key=lambda z: z[:2])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, letters, sha))
    return sorted(out, key=repr)


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, True, "z", 5) for r in rows], TURN)


def result(df, **options):
    return sorted(map(tuple, cv.for_all(df, cv.report(cv.repair(cv.damage(df), **options))).collect()), key=repr)


@pytest.fixture(scope="module")
def odd_talks():
    rng, rows = random.Random(3), []
    for c in [None, *range(200)]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 20])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "unknown", None])
            rows.append((c, rng.choice([t, t, t, t, rng.randrange(12), None]), role, rng.choice(["Hi.", "Yes!", "no", "", None, " \n", "What? ", "A.\x0b", "é.", "é"])))
    rows += [(-9, rng.randrange(900), rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a", "b."]) + str(rng.randrange(300)) + rng.choice([".", ""])) for _ in range(1_000)]
    return rows + [(777, 5, "user", "Same.")] * 60


@pytest.mark.parametrize("most", [1, 3, 40, cv.ROWS])
def test_repair(spark, odd_talks, most):
    assert result(talks(spark, odd_talks).repartition(5), most=most) == repaired(odd_talks)


def test_repair_gives_legal_rows(spark, odd_talks):
    made = cv.repair(cv.damage(talks(spark, odd_talks)), most=7)
    rows = made.rows().orderBy("conv_id", "part", "seg", "pos").collect()
    found = {}
    for r in rows:
        found.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("s?(ua)+", "".join(x)) for x in found.values())
    assert set(found) == {r[0] for r in repaired(odd_talks) if set(r[7]) - {"D"}}


def test_repair_edges(spark):
    assert result(talks(spark, [])) == []
    gone = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert result(talks(spark, [(gone, 0, "user", "x.")])) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_repair_sql(spark, odd_talks):
    con, columns = duckdb.connect(), "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in odd_talks if r[0] != -9])
    assert sorted(con.sql(f"SELECT {columns} FROM ({queries.OP13_SQL})").fetchall(), key=repr) == repaired([r for r in odd_talks if r[0] != -9])
