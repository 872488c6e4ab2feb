"""Divergence audit, conversation repair and Hilbert shards on awkward tables, against brute force."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsift.llm import conversation_repair, divergence
from loomsift.llm.conversation_repair import faults, repair_reports, repaired_digests, repaired_turns, solve
from loomsift.llm.divergence import divergence_audit
from loomsift.llm.queries import QUERIES, damaged
from loomsift.llm.sharding import hilbert_index, hilbert_shards, shards_for, write_shards

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_of(rows, least_docs, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        in_docs = collections.Counter(t for r in own for t in set(r[2]))
        kept = [t for t, n in in_docs.items() if n >= least_docs]
        counts = {s: collections.Counter(t for r in own if r[1] == s for t in r[2] if in_docs[t] >= least_docs) for s in {r[1] for r in own}}
        whole = sum(counts.values(), collections.Counter())
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


def prose(seed, n):
    draw = random.Random(seed)
    words = ["The", "the", "été", "WASSER", "x1y", "naïve", "日本", "a-b", "don't", "ß", "Zebra", "zebra"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    return " ".join(draw.choices(words, [len(words) / (i + 1) for i in range(len(words))], k=n))


@pytest.fixture(scope="module")
def written(spark):
    rows = [(lang, source, prose(i, 30 + i)) for i, (lang, source) in enumerate(itertools.product(["en", "de", None], ["a", "b", "é", None] * 4))]
    rows += [("en", "alone", None), ("fr", "a", ""), ("fr", "b", "12 34"), ("it", "only", "uno due tre")] + [("en", "a", prose(3, 40))] * 5 + [("es", "long", prose(7, 30_000))] * 3
    rows += [("en", "hot", prose(100 + i, 20)) for i in range(80)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string").repartition(5)


@pytest.mark.parametrize("top", [3, 200])
def test_divergence(written, top, monkeypatch):
    rows, docs = written
    want = audit_of(rows, 3, top)
    assert sorted(map(tuple, divergence_audit(docs, top=top).collect())) == want
    # Without sending groups, and in small batches.
    monkeypatch.setattr(divergence, "SEND_BYTES", 0)
    assert sorted(map(tuple, divergence_audit(docs, top=top).collect())) == want


def test_divergence_without_rows_or_terms(spark):
    kind = "lang string, source string, text string"
    assert divergence_audit(spark.createDataFrame([], kind)).count() == 0
    rows = [("en", "a", "one two"), ("en", "b", None), (None, None, "!")]
    assert sorted(map(tuple, divergence_audit(spark.createDataFrame(rows, kind)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_pairs_and_counts_in_small_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "_PAIRS", 7)
    draw = np.random.default_rng(5)
    sizes = [1, 4, 9, 2]
    start = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    end = start + np.repeat(sizes, sizes)
    place = np.concatenate([draw.permutation(10)[:s] for s in sizes])
    p, p0 = draw.integers(5, 10**9, len(place)), draw.integers(1, 50, 10)[place]
    want = collections.Counter()
    f = lambda a, b: (a - b) ** 2 // b
    for i in range(len(place)):
        for j in range(start[i], end[i]):
            if i != j:
                a, b, a0, b0 = map(int, (p[i], p[j], p0[i], p0[j]))
                want[int(place[i]), int(place[j])] += f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
    got = collections.Counter()
    for code, value in divergence.pair_sums(start, end, place, p, p0):
        for c, v in zip(code.tolist(), value.tolist(), strict=True):
            got[c >> 31, c & (2**31 - 1)] += v
    assert got == want


def cheapest(turns):
    """(cost, edits) by trying all edits; turns: (initial, forced, cut)."""

    @functools.cache
    def best(i, state, inserted):
        step = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        found = [(5 + c, "I" + e) for c, e in [best(i, step, inserted + 1)]] if inserted < 3 else []
        if i == len(turns):
            return min([*found, (0, "")] if state in ("", "a") else found or [(10**6, "")])
        initial, forced, cut = turns[i]
        c, e = best(i + 1, state, 0)
        found.append((2 + c, "D" + e))
        if not forced:
            if initial == step or initial == "s" and state == "":
                c, e = best(i + 1, initial, 0)
                found.append((5 * cut + c, "K" + e))
            c, e = best(i + 1, step, 0)
            found.append((1 + 5 * cut + c, "R" + e))
        return min(found)

    for i in range(len(turns), -1, -1):  # from the end on, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def as_arrays(turns):
    role = np.array(["?sua".index(r) for r, _, _ in turns], np.int64)
    return role, np.array([f for _, f, _ in turns], bool), np.array([c for _, _, c in turns], bool)


@pytest.mark.parametrize("block", [2048, 1, 3])
def test_cheapest_edits(block, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    draw = random.Random(11)
    chats = [[(draw.choice("?suuaa"), draw.random() < 0.15, draw.random() < 0.2) for _ in range(n)] for n in [0, 1, 2, 3, 4, 5, 7, 8, 9, 15] * 12]
    got = solve([as_arrays(c) for c in chats])
    assert [(c, e.decode()) for c, e in got] == [cheapest(c) for c in chats]


def test_all_short_conversations():
    chats = [[(r, False, c) for r, c in zip(roles, cuts, strict=True)] for n in range(4) for roles in itertools.product("sua?", repeat=n) for cuts in itertools.product([False, True], repeat=n)]
    assert [(c, e.decode()) for c, e in solve([as_arrays(c) for c in chats])] == [cheapest(c) for c in chats]


def report_of(rows):
    """From original rows (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
            turns += [(turn, "user" if by == 4 else role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).hexdigest()))
        seen, marks = set(), []
        for _, role, text in turns:
            kind = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if text.strip(" \t\n\v\f\r")[-1] not in ".!?" else ""
            seen.add((role, text))
            marks.append(kind)
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(tuple((i if i in ("s", "u", "a") else "?", m in ("blank", "duplicate"), m == "truncated") for i, m in zip(initials, marks, strict=True)))
        state, at, said = "", 0, []
        for edit in audit:
            due = "a" if state == "u" else "u"
            if edit == "I":
                said.append(("user" if due == "u" else "assistant", ""))
            elif edit != "D":
                said.append((turns[at][1] if edit == "K" else "user" if due == "u" else "assistant", turns[at][2]))
            at += edit != "I"
            state = said[-1][0][:1] if edit != "D" else state
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def chats(n):
    draw = random.Random(3)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(draw.choice([1, 2, 3, 6, 9])):
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 3]), draw.choice(["user", "assistant", "system", "tool", "agent", "User", "", None]) if draw.random() < 0.3 else ["user", "assistant"][turn % 2], draw.choice(["Yes.", "yes!\n", "well", "é?", " \t", "", None, "a.b \x0b", "line\nend"])))
    rows += [(5000, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300)] + [(5001, 0, "user", "long " * 100_000 + ".")] + [(5002, 2, "user", "same.")] * 4
    return rows


def test_reports_against_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(conversation_repair, "AT_ONCE", 50)
    rows = chats(150)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("audit", F.lit("x")).repartition(4)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == report_of(rows)
    found = faults(damaged(table), gone=F.col("gone"))
    turns = repaired_turns(found, repair_reports(found)).collect()
    told = collections.defaultdict(list)
    for t in sorted(turns, key=lambda t: t.place):
        told[t.conv].append(f"{t.role}:{t.text}")
    assert {c: hashlib.sha256("\n".join(told[c]).encode()).hexdigest() for c in got} == {c: r[-1] for c, r in got.items()}


def test_no_conversations(spark):
    found = faults(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair_reports(found).count() == 0
    assert repaired_digests(found, repair_reports(found)).count() == 0


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_goes_to_a_neighbour_each_step(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = hilbert_index(list(grid.T), bits)
    assert sorted(at.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards(spark, tmp_path):
    rows = [(i, f"text {i}" * (i % 50), ["en", "de", None, "fr"][i % 4], f"src{i % 7}") for i in range(500)]
    rows += [(i, "a text that many share", "en", "hot") for i in range(1000, 1400)] + [(7, "same row", "en", "web")] * 90 + [(None, None, None, None)] * 20 + [(9000, "z" * 300_000, "en", "web"), (9001, "", "en", "web")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, shard int").repartition(6)
    docs.drop("shard").write.parquet(f"{tmp_path}/documents.parquet")
    put = QUERIES["op13_hilbert_sharding"](spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in put) == collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert {r.law for r in put} == {"rows"} and {r.grown_shard for r in put} == {None}
    slots = collections.defaultdict(list)
    for r in put:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # The order is that of the curve.
    path = [r.curve for r in sorted(put, key=lambda r: (r.shard, r.slot))]
    assert path == sorted(path)
    # Equal texts stay together but for the ends of runs.
    held = sorted({r.shard for r in put if 1000 <= (r.doc_id or 0) < 1400})
    assert held == list(range(held[0], held[-1] + 1)) and len(held) <= 400 // (len(rows) // 24) + 2
    # All columns of the operator's rows come back, and a column that clashes gives way.
    again = hilbert_shards(docs, 5, by=["lang", "source"], tie=["doc_id"], name="shard")
    assert again.columns == ["doc_id", "text", "lang", "source", "shard"] and again.count() == len(rows)
    few = hilbert_shards(docs.limit(3), 5, by=["lang"], tie=["doc_id"]).collect()
    assert sorted((r.sharding.shard, r.sharding.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert_shards(docs.where("false"), 5, by=["lang"], tie=["doc_id"]).count() == 0


def test_written_shards_are_skipped(spark, tmp_path):
    docs = spark.range(20_000).select("id", (F.hash("id") % 1000).alias("x"), F.concat(F.lit("host"), F.pmod(F.hash("id", F.lit(3)), F.lit(40))).alias("host"), F.rand(4).alias("score"))
    rows = docs.collect()
    docs = spark.createDataFrame(rows, docs.schema)
    manifest = write_shards(docs, f"{tmp_path}/shards", 64, by=["x", "host", "score"], tie=["id"])
    assert manifest.agg(F.sum("n")).first()[0] == 20_000 and manifest.count() == 64
    back = spark.read.parquet(f"{tmp_path}/shards/rows")
    assert sorted(map(tuple, back.drop("shard").collect())) == sorted(map(tuple, rows))
    for box, rule in (({"x": (0, 200)}, "x between 0 and 200"), ({"host": ("host11", "host12")}, "host between 'host11' and 'host12'"), ({"score": (0.9, 1.0), "x": (-999, -500)}, "score >= 0.9 and x <= -500")):
        some = {r[0] for r in shards_for(manifest, box).select("shard").collect()}
        assert {r[0] for r in back.where(rule).select("shard").distinct().collect()} <= some
        assert len(some) <= 40  # of 64; rows in the order of ids are in all of them
