"""Ops 3, 6 and 8 against plain code."""

import hashlib
import ipaddress
import random
import re

import pytest
from compare import same
from pyspark.sql import functions as F

from tidewell.llm import licenses, mixing, pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def redacted(text, spans):
    """Spans as the report names them, replaced by their kind; of those that overlap the first."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pii_with_many_spans(spark):
    """Texts whose matches fill many blocks, against plain code: base spans, overlaps, redaction."""
    rng = random.Random(12)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    parts = [lambda: digits(rng.randint(1, 17)), lambda: f"+1 555 {digits(3)} {digits(4)}", lambda: f"call {digits(3)}-{digits(4)}", lambda: "10.0.0." + digits(2), lambda: "a@b.c", lambda: "é日 word", lambda: f"IBAN DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choice(parts)() for _ in range(n)) for n in (0, 1, 63, 64, 65, 257, 3000, 9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.report(docs).collect()}
    after = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        added = sorted(tuple(map(int, x.split(":")[1:])) for x in set(found[i].spans.split(",")) - set(want) - {""})
        base = sorted(tuple(map(int, x.split(":")[1:])) for x in want)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:])) and not any(b[0] < a[1] and a[0] < b[1] for a in added for b in base)
        assert after[i] == redacted(text, found[i].spans)
    assert len(found[7].spans.split(",")) > 3000


def test_overlapping_proposals_are_chosen_by_score(spark):
    """Of a chain the outer two stay; in general as a greedy choice by score, then place, does it."""
    rng = random.Random(15)
    cases = [[(0, 10, 1, 3.0), (8, 20, 2, 2.0), (18, 30, 1, 1.0)], [], [(0, 4, 1, 1.0)]]
    for n in (2, 5, 40, 300):
        spans = [(s, s + rng.randint(1, 9), rng.randint(1, 3), float(rng.randint(0, 5))) for s in (rng.randint(0, 4 * n) for _ in range(n))]
        cases.append(sorted(set(spans)))
    better = "o.m > x.m or (o.m = x.m and (o.start < x.start or (o.start = x.start and (o.end > x.end or (o.end = x.end and o.kind < x.kind)))))"
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, scored array<struct<start:int,end:int,kind:int,m:double>>").select("k", F.expr(f"array_sort({pii._chosen('scored', better)})").alias("s")).collect()
    for k, got in rows:
        want = []
        for x in sorted(cases[k], key=lambda x: (-x[3], x[0], -x[1], x[2])):
            if not any(o[0] < x[1] and x[0] < o[1] for o in want):
                want.append(x)
        assert [tuple(g) for g in got] == sorted(want)
    assert [tuple(g)[:2] for g in rows[0].s] == [(0, 10), (18, 30)]


def test_pii_cost_stays_near_the_length(spark):
    import time

    rng = random.Random(13)
    text = ", ".join("".join(rng.choice("0123456789") for _ in range(rng.randint(2, 19))) for _ in range(50_000))
    began = time.time()
    assert pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_card > 0
    assert time.time() - began < 90  # half a megabyte of numbers; a cost by the square would take several minutes


def test_calibration_texts_differ_from_those_learned():
    train, back = pii.sentences(), pii.calibration()
    assert not {s["text"] for s in train} & {s["text"] for s in back} and {s["label"] for s in back} == {0, 1}


def test_pii_base_and_added(spark):
    rng = random.Random(2)
    parts = [*"ab1234567890.-+ @%_()é🎉\n", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188aabb"', "call 555-7713"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)), "1" * 40000, "a" * 40000 + "@b.c", "a@" + "b." * 15000 + "c", "1.1." * 9000]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""} and r.n_email == sum(w.startswith("email") for w in want)


def test_pii_method_adds_and_spares(spark):
    texts = ['the token = "04dbebab91ab85687d33eeaaf9ac699e1188aabb" here', "write to ana [at] example [dot] org", "in chapter 12-34 of 2024-01-02", "just words and nothing else"]
    spans = [r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert spans[0].startswith("secret:") and spans[1].startswith("email:") and spans[2:] == ["", ""]


def test_pii_long_and_compressed_forms(spark):
    rng = random.Random(9)
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(n - 2)) + "07"
    spans = [("secret", 'the token = "', mixed(n)) for n in (128, 129, 200, 700, 5000, 60000)]
    spans += [("ip", before, ip) for before in ("host ", "it came from client ") for ip in ("2001:db8::1", "fe80::1", "2001:db8:85a3::8a2e:370:7334", "2001:db8:1:2:3:4:5::", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]
    spans += [("email", "write to ", name + " [at] " + host) for name in ("ana", "j.smith" * 12, "a1" * 20000) for host in ("example [dot] org", "a.b.c.d.e.f.example.org")]
    spare = ["std::vector and std::add", "call cafe::bed now", "a :: b", "at 10:30:45 it rang", "of the checksum " + "0a1b2c3d" * 16, "x" * 50000 + "1"]
    texts = [before + body + ' " here' for _, before, body in spans] + spare
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r.spans for r in pii.report(docs).orderBy("doc_id").collect()]
    assert rows == [f"{k}:{len(before)}:{len(before) + len(body)}" for k, before, body in spans] + [""] * len(spare)
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == [f'{before}[{k.upper()}] " here' for k, before, _ in spans] + spare


def test_compressed_addresses_against_the_library():
    rng = random.Random(6)
    pattern = re.compile(pii.GENERATORS[-1][1])
    n = 0
    for _ in range(30000):
        sides = [":".join("%x" % rng.randrange(1 << rng.choice([4, 8, 16, 17])) for _ in range(rng.randint(0, 5))) for _ in range(rng.choice([1, 2, 2, 2, 2, 3]))]
        text = "::".join(sides)
        try:
            ipaddress.IPv6Address(text)
            want = "::" in text and text != "::"
        except ValueError:
            want = False
        n += want
        assert [m.group() for m in pattern.finditer(f"at {text}, then")] == [text] * want, text
    assert n > 5000


def test_pii_awkward(awkward, nothing):
    done = pii.redact(awkward)
    assert done.columns == awkward.columns and done.count() == awkward.count()
    assert [r.text for r in done.where("doc_id in (3, 8)").orderBy("doc_id").collect()] == [None, "mail [EMAIL] or [PHONE] now 😀"]
    assert pii.redact(nothing).count() == pii.report(nothing).count() == 0


def test_oracles(spark, oracle):
    for name in ("op3_mixing", "op6_license_scan"):
        same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), oracle.sql(queries.ORACLES[name]))


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice("aaaaaaabbc") if i % 11 else None) for i in range(4000)]
    out = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies").collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
    sources = {r.source: (r.source_size, r.target) for r in out}
    assert sum(t for _, t in sources.values()) == pytest.approx(sum(s for s, _ in sources.values()))
    for source, (size, target) in sources.items():
        assert target <= 3 * size + 1e-9
        assert sum(r.taken for r in out if r.source == source) == pytest.approx(target, rel=0.02, abs=120)


def test_mixing_of_rows_alike(spark):
    """Rows that share id and size, or everything: as many as the sums ask for, the same ones whatever the partitions."""
    rows = [(i % 40, f"w {i % 7} " * (i % 5), "a" if i % 3 else "b", i % 2) for i in range(600)] + [(None, "x y", None, 0)] * 30 + [(None, "y x", None, 1)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    want = sorted(map(str, mixing.emit(docs).collect()))
    assert want == sorted(map(str, mixing.emit(docs.repartition(7)).collect()))
    narrow = mixing.with_copies(docs)
    assert len(want) == narrow.agg(F.sum("copies")).first()[0] and narrow.count() == len(rows)


def test_mixing_awkward(awkward, nothing):
    mixed = mixing.emit(awkward)
    assert mixed.columns == awkward.columns and mixed.where("text is null or trim(text) = ''").count() == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.emit(awkward).collect()))
    assert mixing.with_copies(awkward.select("doc_id", "text", "source")).count() == awkward.count() and mixing.emit(nothing).count() == 0


def test_license_blocks(awkward, nothing, spark):
    texts = ["Released under the\nMIT License.", "this work is licensed under the gnu general public license", "of the and in", None, ""]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", "gpl-3", "", "", ""] and rows[0].n_base == 1 and (rows[0].first_word, rows[0].last_word) == (1, 1) and rows[1].score == pytest.approx(10 / 12)
    assert licenses.scan(awkward).count() == awkward.count() and licenses.scan(nothing).count() == 0


def brute_labels(text):
    rows = [licenses.WORD.findall(line) for line in licenses.lower(text).split("\n")]
    run = [w for words in rows for w in words]
    shares = {}
    for label, template in licenses.TEMPLATES:
        words = licenses.WORD.findall(template)
        size, own = -(-len(words) * 5 // 4), set(words)
        blocks = rows + [a + b for a, b in zip(rows, rows[1:])] + [run[i : i + size] for i in range(len(run))]
        best = max(len(own.intersection(b)) for b in blocks) / len(own)
        if best >= 0.8 - 1e-9:
            shares[label] = max(best, shares.get(label, 0))
    return ",".join(sorted(shares)), max(shares.values(), default=0.0)


def test_license_statements_over_many_lines(spark):
    grant = dict((t.split()[0], t) for _, t in licenses.TEMPLATES)["permission"]
    rng, noise = random.Random(4), "lorem ipsum dolor amet the of work software public version".split()
    texts = [grant.replace("charge ", "charge,\n").replace("software ", "software\n"), grant.replace("charge ", "charge\n\n# ---\n# lorem ipsum\n# ").replace("software ", "software\n")]
    for i in range(320):
        words = licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1].split()
        for _ in range(rng.randint(0, len(words) // 4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(noise)]
        cuts = sorted(rng.sample(range(1, len(words)), min(rng.randint(2, 4), len(words) - 1)))
        parts = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
        around = [" ".join(rng.choice(noise) for _ in range(rng.randint(0, 9))) for _ in range(2)]
        texts.append("\n".join([around[0], rng.choice(["\n# ", "\n\n * ", "\n# lorem ipsum\n# "]).join(parts), around[1]]))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.labels for r in rows if r.doc_id < 2] == ["mit", "mit"]
    for r in rows:
        labels, score = brute_labels(texts[r.doc_id])
        assert set(r.labels.split(",")) - {""} == set(f"{labels},{r.base_labels}".split(",")) - {""}, texts[r.doc_id]
        assert r.score == pytest.approx(1.0 if r.base_labels else score)
