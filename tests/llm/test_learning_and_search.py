"""Operators 3, 7 and 9, the pipeline, and what the registered queries return."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from chronolock.llm import decontamination, packing, pii_bootstrap, quality_mil, registry
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def test_decontamination_finds_edited_passages_only(spark, make_docs):
    rng = random.Random(9)
    items = [(i, prose(rng, 25)) for i in range(20)]
    docs = [(i, prose(rng, 120)) for i in range(20)]
    for i in range(5):  # whole, in other case and punctuation, with edits, a long part, a short part
        words = docs[i][1].split()
        body = items[i][1]
        body = [body, body.upper().replace(" ", ",  "), body[:40] + "x" + body[41:90] + body[91:], body[10:], " ".join(body.split()[:3])][i]
        docs[i] = (i, " ".join(words[:50]) + " " + body + " " + " ".join(words[50:]))
    bench = spark.createDataFrame([*items, (99, None), (98, "tiny"), (None, prose(rng, 30))], "item_id long, text string")
    every = [*docs, (50, None), (51, ""), (52, docs[0][1]), (None, docs[1][1])]
    for block in (decontamination.BLOCK, 1500):
        got = decontamination.contaminated(make_docs(every, clashes=True), bench, block=block).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in got) == [(-1, 1), (0, 0), (1, 1), (2, 2), (3, 3), (52, 0)]
    spot = next(r for r in got if r.doc_id == 0)
    assert items[0][1][20:60] in docs[0][1][spot.start : spot.end]
    left = decontamination.drop_contaminated(make_docs(every, clashes=True), bench)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [*range(4, 20), 50, 51]
    assert decontamination.contaminated(make_docs([]), bench).count() == 0
    assert decontamination.contaminated(make_docs(every), bench.limit(0)).count() == 0


def test_lemma_keeps_every_window_within_the_budget():
    rng = random.Random(10)
    item = prose(rng, 40)
    index = decontamination.build([(1, item)], window=80)
    for _ in range(60):
        s = rng.randrange(0, len(item) - 100)
        part = list(item[s : s + 100 + 40][:130])
        for _ in range(2):
            part[rng.randrange(len(part))] = rng.choice("qxz")
        text = prose(rng, 30) + " " + "".join(part) + " " + prose(rng, 30)
        if len(part) == 130:
            assert decontamination.search([text], index)


def test_short_items_and_control_characters(spark, make_docs):
    bench = spark.createDataFrame([(1, "Yes, 42."), (2, "What is the capital?"), (3, "a passage of words that is long enough to be cut into windows and be found in a text")], "item_id long, text string")
    docs = [(1, " yes 42"), (2, "yes 42 and more"), (3, "so WHAT  is the\ncapital of it"), (4, "what is a capital"), (5, bench.where("item_id = 3").first().text.replace(" ", "\x01")), (6, "so\x02" + bench.where("item_id = 3").first().text.replace(" ", "\x02"))]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(make_docs(docs), bench).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (6, 3)}


def test_quality_learns_and_holds_out(spark, make_docs, odd_texts):
    rng = random.Random(11)
    good = [(i, "\n".join(prose(rng, 30).capitalize() + "." for _ in range(3))) for i in range(0, 300, 2)]
    bad = [(i, "\n".join([prose(rng, 20), " ".join([rng.choice("abcdef") * 3 + "!!"] * 30).upper()])) for i in range(1, 300, 2)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (9999, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(good + bad + [(1000 + n, t) for n, (_, t) in enumerate(odd_texts)] + [(None, "none")], clashes=True)
    model = quality_mil.train(docs, labels)
    got = quality_mil.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = dict([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad])
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = quality_mil.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality_mil.score(make_docs([]), quality_mil.train(make_docs([]), labels)).count() == 0


def test_quality_on_the_given_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_mil.score(docs, quality_mil.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def slow_spans(text: str) -> list[tuple[int, int, int]]:
    shapes = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for kind, shape in enumerate(shapes):
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == 1:
                ok = all(int(p) <= 255 for p in m[0].split("."))
            if kind == 2:
                total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
                ok = 12 <= len(digits) <= 19 and total % 10 == 0
            if kind == 3:
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_as_defined():
    rng = random.Random(12)
    bits = ["a", "b.", "@", "c-d", ".", "..", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (555) 555-0101", "\n", "é", "00000300"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii_bootstrap.base_spans(text) == slow_spans(text), text


def test_patterns_discover_what_no_expression_finds(spark, make_docs):
    rng = random.Random(13)
    good = []
    for i in range(12):
        digits = f"4{rng.randrange(10**14):014d}"
        check = next(c for c in "0123456789" if pii_bootstrap.luhn(digits + c))
        good.append(digits + check)
    docs = [(i, f"Please note that my card is: {n} and so on") for i, n in enumerate(good)]
    wrong = str(int(good[0]) + 1)
    docs += [(50, f"Again my card is: {wrong} as said"), (51, f"the count was {wrong} then"), (52, None), (53, ""), (50, f"Again my card is: {wrong} as said")]
    got = pii_bootstrap.find(make_docs(docs, clashes=True)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    text = docs[12][1]
    assert [(s.start, s.kind, s.end) for s in by[50].added] == [(text.index(wrong), 2, text.index(wrong) + 16)]
    assert not by[51].added and not by[52].base and not by[53].base
    assert all(len(by[i].base) == 1 and not by[i].added for i in range(12))
    assert pii_bootstrap.find(make_docs([])).count() == 0


def test_secrets_and_identifiers_without_digits(spark, make_docs):
    rng = random.Random(14)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (*[40] * 8, 36, 35)]
    docs = [(i, f"the {w} token = \"{h}\" {w}") for i, (h, w) in enumerate(zip(hexes, "one two three four five six seven eight nine ten".split()))]
    docs += [(20 + i, f"write to me at user{i}@mail{i}.example.com if you can") for i in range(6)] + [(40, "write to me at alice7@localhost if you can")]
    docs += [(50, "a hash " + hexes[8] + " in another place"), (51, "token = 12345678 is a number")]
    by = {r.doc_id: r for r in pii_bootstrap.find(make_docs(docs)).collect()}
    for i, (_, text) in enumerate(docs[:10]):
        assert [(s.start, s.kind, s.end) for s in by[i].added] == [(text.index(hexes[i]), pii_bootstrap.SECRET, text.index(hexes[i]) + len(hexes[i]))], i
    assert not by[40].added  # no dot: not of the shape of a known email
    assert not by[50].added and not by[51].added


def test_candidates_are_runs_and_words():
    text = "call 020 7946 0958 or (555) 010-99 44, ask alice@home or x12345 of 1.2.3.4"
    found = [text[s:e] for s, e in pii_bootstrap.candidates(text, pii_bootstrap.base_spans(text))]
    assert found == ["020 7946 0958", "(555) 010-99 44", "alice@home", "x12345"]


def test_registered_queries_return_their_columns(spark):
    want = {
        "op2_": "page_id payload_bytes payload_digest record_type refers_to", "op4_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op5_": "doc_id n_bytes n_tokens over_limit", "op6_": "page_id url text n_chars", "op7_": "doc_id held_out score predicted", "op8_": "doc_id fingerprint component_id",
        "op9_": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10_": "doc_id piece start length ids_crc32 sequence_id offset",
    }
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in registry.QUERIES) == 1
    for start, columns in want.items():
        name = next(q for q in registry.QUERIES if q.startswith(start))
        df = registry.QUERIES[name](spark, SF)
        assert set(columns.split()) <= set(df.columns), name
    nine = registry.QUERIES["op9_pii_bootstrap"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in nine:
        spans = slow_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{pii_bootstrap.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in spans) for j in range(4))


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        steps[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(steps[name]) == docs.count()
    good, lines, near, clean = steps.values()
    labels = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()
    assert sum((i in good) == bool(q) for i, q in labels) >= 0.95 * len(labels)
    kept = [x for t in lines.values() for x in t.split("\n") if len(x) >= 20]
    assert len(kept) == len(set(kept))
    assert set(kept) <= {x for t in good.values() for x in t.split("\n")}
    from chronolock.llm.simhash_anchor import shingle_set

    sets = {i: shingle_set(t or "", 5) for i, t in near.items()}
    ids = sorted(sets)
    assert not [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [flat(t) for _, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    assert {i for i in near if any(x in flat(near[i]) for x in items)} == set(near) - set(clean)
    rows = packing.pack_documents(docs).collect()
    assert {r.doc_id for r in rows} == set(clean) <= set(before)
    assert {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.piece) for r in rows}


def test_pipeline_stands_empty_and_odd_tables(spark, make_docs, odd_texts):
    for rows in ([], odd_texts):
        docs = make_docs(rows, clashes=True)
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, SF)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= (0 if not rows else 5)


@pytest.mark.parametrize("column", ["doc_id", "text"])
def test_missing_columns_are_named(make_docs, column):
    from chronolock.llm.common import doc_texts

    with pytest.raises(ValueError, match=column):
        doc_texts(make_docs([(1, "x")]).drop(column))


def test_bands_count_every_shared_q_gram(monkeypatch):
    """Runs and chunks give the counts of all pairs of equal q-grams, in texts that repeat much."""
    import random

    monkeypatch.setattr(decontamination, "CHUNK", 37)
    rng = random.Random(12)
    for _ in range(25):
        letters = rng.choice(["a", "ab", "abc"])
        items = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(12, 130)))) for k in range(3)]
        index = decontamination.build(items)
        text = "".join(rng.choice([rng.choice(letters) * rng.randrange(1, 40), rng.choice(items)[1][:60]]) for _ in range(12))
        cp, _, _ = decontamination.normalised([text])
        h = decontamination.spans(decontamination.prefix(cp), np.arange(len(cp) - 11), np.arange(len(cp) - 11) + 12)
        budget, want = int(index.budget.max()), {}
        for w in range(len(index.items)):
            own = index.chars[index.begin[w] : index.begin[w + 1]]
            g = decontamination.spans(decontamination.prefix(own), np.arange(len(own) - 11), np.arange(len(own) - 11) + 12)
            for s, o in zip(*np.nonzero(h[:, None] == g[None, :])):
                d = int(s) - int(o) + 16 * 64
                for band in {d // 16, (d - budget) // 16}:
                    want[w, band] = want.get((w, band), 0) + 1
        want = {(w, b) for (w, b), n in want.items() if n >= index.begin[w + 1] - index.begin[w] - 11 - 12 * index.budget[w]}
        at = np.flatnonzero(np.isin(h, index.keys))
        key = np.searchsorted(index.keys, h[at])
        if len(at):
            run = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])))
            got = decontamination._bands(at[run], np.diff(np.append(run, len(at))), key[run], index)
            assert set(zip(*(x.tolist() for x in got))) == want


def test_one_letter_again_and_again_needs_little_memory():
    import tracemalloc

    index = decontamination.build([(1, "0" * 400)])
    tracemalloc.start()
    found = decontamination.search(["0" * (1 << 17)], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[:4] for r in found] == [(0, 1, 9, 0)] and peak < 300e6


def test_chunks_of_passages_change_nothing(monkeypatch):
    rng = random.Random(21)
    texts = ["", "\n\n", "one", "x" * 5000 + " y", "\n".join(rng.choice(["", " ", "a b a", "Some Words, here!", "z" * 900]) for _ in range(300)), prose(rng, 900), "\n \nend"]
    whole, first = quality_mil.encode(texts)
    model = quality_mil.fit(whole, first, np.array([0, 1, 0, 1, 1, 0, 1], np.float32), rounds=5)
    plain = model.forward((whole - model.mean) / model.scale, first)[-1]
    for size in (1, 7, 1 << 13):
        monkeypatch.setattr(quality_mil, "CHUNK", size)
        again, starts = quality_mil.encode(texts)
        assert (again == whole).all() and (starts == first).all()
        assert np.allclose(model.score(texts), plain, atol=1e-6)


def test_a_text_of_many_lines_needs_little_memory():
    import tracemalloc

    model = quality_mil._fitted([])
    text = "\n".join("ab" for _ in range(400_000))
    tracemalloc.start()
    got = model.score([text, "short"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ((0 <= got) & (got <= 1)).all() and peak < 250e6
