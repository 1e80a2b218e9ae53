"""Repairs against a search through every edit, in order of cost and then of the audit."""

import hashlib
import heapq
import random
import re
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from callgrove.llm import conversation_repair as R

DDL = "conv_id long, turn int, role string, text string, id string, audit string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
PART = re.compile(r"s?(ua)*u?")


def damage(rows):
    out, ids = [], {}
    for i, turn, role, text in rows:
        say = [" " if x is None else str(x) for x in (i, turn, role, text)]
        ids[i] = None
        kind = zlib.crc32(f"{say[0]}:{say[1]}".encode()) % 20
        role, text = say[2], say[3]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(i, turn, role, text)] * (2 if kind == 3 else 1)
    return out, list(ids)


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(turns, wrong):
    """Every edit is tried, cheapest first and by audit; the first whole one is the answer."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, at, said = heapq.heappop(heap)
        roles = "".join(r[:1] or "-" for r, _ in said)
        if at == len(turns) and GRAMMAR.fullmatch(roles):
            return cost, audit, said
        if not PART.fullmatch(roles) or cost > 4 * len(turns):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, (*said, (role, ""))))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, said))
            if wrong[at] not in ("blank", "duplicate"):
                more = 3 * (wrong[at] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*said, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, (*said, (new, text))))
    raise AssertionError


def want(rows, find=search, hurt=True):
    rows, ids = damage(rows) if hurt else (rows, list({r[0]: None for r in rows}))
    out = {}
    for i in ids:
        turns = sorted(((t, r, x) for c, t, r, x in rows if c == i), key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        wrong = faults(turns)
        cost, audit, said = find(turns, wrong)
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        roles = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        out[i] = (gaps, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest())
    return out


def got(df):
    found = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return found


def table(spark, rows):
    return spark.createDataFrame([(*r, "mine", "DD") for r in rows], DDL).repartition(5)


def talk(rng, ids, most):
    texts = ["a.", "b!", "c", "", " \t", "a. ", "long? no", None, "d?\n", "."]
    roles = ["system", "user", "assistant", "tool", "", None, "User", "admin"]
    weights = [2, 6, 6, 1, 0.3, 0.3, 0.3, 0.5]
    return [(i, rng.choice([None, *range(most)]) if rng.random() < 0.2 else t, rng.choices(roles, weights)[0], rng.choice(texts)) for i in ids for t in range(rng.randrange(1, most + 1))]


def test_shortest_paths(spark):
    rng = random.Random(11)
    rows = talk(rng, range(250), 5)
    assert got(R.repair_reports(R.damaged(table(spark, rows)), absent=F.col("absent"))) == want(rows)


def test_paths_over_symbols():
    """All short conversations of a few symbols against the search."""
    kinds = [("user", "x."), ("assistant", "y."), ("system", "z."), ("tool", "w."), ("user", "cut"), ("assistant", "")]
    rng = random.Random(4)
    for _ in range(1500):
        turns = [(k, *rng.choice(kinds)) for k in range(rng.randrange(0, 6))]
        turns = [(t, r, x.replace(".", f"{t}.") if rng.random() < 0.7 else x) for t, r, x in turns]
        wrong = faults(turns)
        codes = bytes(["", "truncated", "duplicate", "blank"].index(w) * 4 + "?sua".index(r[0] if r[0] in "sua" else "?") for (_, r, _), w in zip(turns, wrong, strict=True))
        assert R.cheapest(codes) == search(turns, wrong)[:2], turns


def by_steps(turns, wrong):
    """Costs and audits of whole suffixes, compared as they are."""
    nxt = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {q: (0, "", ()) for q in ("", "a")}
    for at in range(len(turns), -1, -1):
        if at < len(turns):
            _, role, text = turns[at]
            more, now = 3 * (wrong[at] == "truncated"), {}
            for q in nxt:
                take = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
                if wrong[at] not in ("blank", "duplicate"):
                    for label, cost, said in (("K", more, role), ("R", 3 + more, "user"), ("R", 3 + more, "assistant")):
                        if said[:1] in nxt[q]:
                            c, a, s = best[nxt[q][said[:1]]]
                            take.append((c + cost, label + a, ((said, text), *s)))
                now[q] = min(take, key=lambda x: x[:2])
            best = now
        for _ in range(3):
            for q, out in nxt.items():
                for i, role in (("u", "user"), ("a", "assistant")):
                    if i in out and out[i] in best:
                        c, a, s = best[out[i]]
                        best[q] = min(best.get(q, (1 << 30, "", ())), (c + 3, "I" + a, ((role, ""), *s)), key=lambda x: x[:2])
    return best[""]


def test_given_table(spark, sf_dir):
    table = pq.read_table(Path(sf_dir) / "conversations.parquet").to_pylist()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table]
    assert got(R.op12(spark, sf_dir)) == want(rows, by_steps)


def test_one_conversation_over_many_partitions(spark):
    """A conversation with most rows, repeated rows and one turn number for many of them."""
    rng = random.Random(6)
    rows = [(7, t if t % 3 else 5, rng.choice(["user", "assistant", "tool"]), f"said {rng.randrange(400)}" + rng.choice([".", ""])) for t in range(900)]
    rows += [(7, 12, "user", "the same.")] * 600 + [(8, 1, "user", "q?"), (8, 2, "assistant", "a."), (9, 3, "assistant", "a.")]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = R.repair_reports(table(spark, rows))
        assert got(df) == want(rows, by_steps, hurt=False)
        turns = R.repaired_turns(table(spark, rows)).where("conv_id = 7").orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.place for r in turns] == list(range(len(turns))) and GRAMMAR.fullmatch("".join(r.role[0] for r in turns))
    sha = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest()
    assert sha == got(df)[7][-1]


@pytest.mark.parametrize("rows", [[(None, None, None, None)], [(None, 3, "user", "x" * 100_000 + "."), (1, None, "user", "a."), (1, None, "user", "b."), (1, 0, "assistant", "c.")], [(i, 0, "user", "only one.") for i in range(40)]])
def test_odd_rows(spark, rows):
    assert got(R.repair_reports(R.damaged(table(spark, rows)), absent=F.col("absent"))) == want(rows)


def test_no_rows(spark):
    empty = table(spark, [(1, 1, "user", "x")]).limit(0)
    assert R.repair_reports(empty).count() == 0 and R.repaired_turns(empty).count() == 0
