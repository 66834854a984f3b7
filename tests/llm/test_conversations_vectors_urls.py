"""Operators 11, 12 and 13 against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from chronolock.llm import conversation_repair as cr
from chronolock.llm import url_filters, whitening
from chronolock.llm.registry import URL_RULES

CONV = "conv_id long, turn long, role string, text string"


def every_way(initials: str, faults: list[int], inserts: int = 2):
    """Cost and audit of all repairs with so many inserts in a row at most."""

    def grow(i: int, out: str):
        if i == len(initials):
            yield 0, "", out
            return
        yield from ((2 + c, "D" + a, o) for c, a, o in ways(i + 1, out))
        if faults[i] not in (cr.BLANK, cr.DUPLICATE):
            more = 5 * (faults[i] == cr.CUT)
            yield from ((more + c, "K" + a, o) for c, a, o in ways(i + 1, out + initials[i]))
            for x in "ua":
                yield from ((more + 1 + c, "R" + a, o) for c, a, o in ways(i + 1, out + x))

    def ways(i: int, out: str):
        for n in range(inserts + 1):
            for new in itertools.product("ua", repeat=n):
                yield from ((5 * n + c, "I" * n + a, o) for c, a, o in grow(i, out + "".join(new)))

    return min((c, a) for c, a, o in ways(0, "") if re.fullmatch("(s?(ua)+)?", o))


def test_cheapest_is_the_least_of_all_repairs():
    rng = random.Random(5)
    for n in range(5):
        for _ in range(3 if n == 4 else 12):
            initials, faults = "".join(rng.choice("suat") for _ in range(n)), [rng.randrange(4) for _ in range(n)]
            assert cr.cheapest(initials, faults) == every_way(initials, faults, 1 if n == 4 else 2), (initials, faults)


def plain(rows):
    """The digest of each conversation, one at a time."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = ("user" if hit == 4 else role), ("" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
        held += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in held:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = "".join(r[:1] or " " for _, r, _ in held)
        cost, audit = cr.cheapest(initials, [["", "blank", "duplicate", "truncated"].index(f) for f in faults])
        kept, state = [], 0
        it = iter(held)
        for x in audit:
            assert x in "DKR"  # an insert is never cheapest
            _, role, text = next(it)
            if x == "D":
                continue
            if x == "K" and role[:1] == "s":
                assert state == 0
                kept.append((role, text))
                continue
            kept.append((role if x == "K" else ("user", "assistant")[state % 2], text))
            state += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        turns = [t for t, *_ in held if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(9)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["a.", "b?", "c", " \t", None, "", "d! \n", "é", "x" * 5000 + "."]
    rows = [(c, rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for c in range(60) for n in [rng.randrange(1, 12)] for _ in range(n)]
    rows += [(None, i, "user", "q?") for i in range(5)] + [(7, 100, "user", "same.")] * 30
    return rows + [(99, 10**6 * i, "user" if i % 2 else "assistant", f"t{i % 40}.") for i in range(400)]


@pytest.mark.parametrize("most", [cr.LONG, 5])
def test_repairs_one_at_a_time_and_in_pieces(spark, most, monkeypatch):
    monkeypatch.setattr(cr, "FAN", 3)
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as at", "2 as piece", "3 as id").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in cr.repair(df, most).collect()}
    assert got == plain(rows)


def test_no_conversations(spark):
    assert cr.repair(spark.createDataFrame([], CONV)).collect() == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = cr.repair(spark.createDataFrame([(gone, 0, "user", "x.")], CONV)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) / 8).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [])]
    repeats = [(5, rows[5][1]), (None, rows[6][1])]
    df = spark.createDataFrame(rows + odd + repeats, "vec_id long, embedding array<float>").selectExpr("*", "1 as w", "2 as at").repartition(4)
    got = whitening.whiten(df).collect()
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in r] for r in [*v, v[5], v[6]]])
    n = len(x)
    cov = np.cov(x.T.astype(float), bias=True)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    want = (x - x.mean(0)) @ axes[:, :8] / np.sqrt(e[:8])
    assert len(got) == n * 8 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    held = {(r.vec_id, r.component): r for r in got}
    for c in range(1, 9):
        ours = np.array([held[i, c].whitened for i in range(300)])
        sign = np.sign(ours @ want[:300, c - 1])
        assert np.allclose(ours * sign, want[:300, c - 1], atol=1e-8)
        assert abs(held[0, c].explained / (e[c - 1] / e.sum()) - 1) < 1e-9
    s = [sum(int(a) for a in col) for col in x.T]
    for i in (0, 17, 299):
        assert held[i, 1].deviation == sum((n * int(a) - b) ** 2 for a, b in zip(x[i], s))


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [i / 8, i / 4, 0.0]) for i in range(6)], kind)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30, 0.0]), (2, [0.0, 0.0])]):
        with pytest.raises(Exception, match="whitening"):
            whitening.whiten(spark.createDataFrame(bad, kind)).collect()


def test_factor_and_turns():
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (7, 7), (30, 30), (20, 6)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
        a = b @ b.T
        l_, order = whitening.pivoted_cholesky(a)
        assert np.allclose(l_ @ l_.T, a[order][:, order], rtol=1e-9, atol=1e-9 * a.max())
        e, axes = whitening.eigen(a)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][: len(e)], rtol=1e-6, atol=1e-12 * a.max())
        assert np.allclose(axes.T @ axes, np.eye(len(e)), atol=1e-9)


def judged(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_url_filters_against_every_rule(spark):
    rng = random.Random(1)
    label = ["a", "b", "com", "a-b", "é", "z", "www", "", "\x01"]
    hosts = [".".join(rng.choice(label) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["hot.com"] * 40
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/é/", "x" * 3000]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(90)) if h}.values()) + list(URL_RULES)
    urls = [f"http://{rng.choice(hosts).upper()}{rng.choice(paths)}{rng.choice(['', '?q', '#/a', '/b'])}" for _ in range(600)] + ["http://hot.com/a/b"] * 300
    urls += [None, "", "no scheme", "://", "a://b://com/", "http://WWW.Example.com/en/1", "http://example.com/en/", "http://xcom/", "http://com", "http://x.com?/"]
    rows = [(i if i % 50 else None, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'k' as key", "1 as range", "'h' as host", "'v' as verdict").repartition(3)
    given = spark.createDataFrame(rules + [(None, "/", "block"), ("q", None, None)], url_filters.RULES)
    got = sorted(map(str, (tuple(r) for r in url_filters.judge(df, given).collect())))
    assert got == sorted(str((i, *judged(u, rules))) for i, u in rows)


def test_url_filters_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    given = spark.createDataFrame(list(URL_RULES), url_filters.RULES)
    assert url_filters.judge(none, given).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filters.judge(one, given.limit(0), "block").collect()] == [(1, "a.com", "/x", None, "block")]


def test_ranges_hold_every_rule_they_need():
    rng = random.Random(6)
    keys = sorted("".join(rng.choice("ab.") for _ in range(rng.randint(1, 8))) for _ in range(300))
    cuts = sorted({(rng.choice(keys)[:256], rng.choice(["", "/", "/x"]), rng.randrange(9)) for _ in range(20)})
    for k in rng.sample(keys, 80):
        low, high = url_filters.reach(cuts, k)
        for other in keys:
            if other.startswith(k):
                assert low <= url_filters.place(cuts, other, rng.choice(["", "/x", "/zz"]), rng.randrange(9)) <= high
