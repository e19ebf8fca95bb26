"""The ten operators on small fixtures: against brute force, SQL or a round trip, and on odd input."""

import glob
import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliosift.llm import common, decontaminate, imagecopies, language, licenses, nearset, packing, registry, resharding, secrets, toxicity, urlfilters

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, spans_of string, n long, u string, lang string"


def docs(spark, rows, schema="doc_id long, text string, size_ string, u long, subset string"):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)


def test_tables_go_with_their_result_and_with_a_failure(spark):
    folder = common.shared_dir(spark).removeprefix("file:")
    seen = lambda: set(glob.glob(f"{folder}/foliosift-alone-*"))

    def build(fail):
        df = common.cut(common.cut(spark.range(3), "alone-one").where("id > 0"), "alone-two")
        if fail:
            raise OSError
        return df

    with pytest.raises(OSError):
        common.alone(lambda: build(True), "alone-out")
    assert not seen()
    out = common.alone(lambda: build(False), "alone-out")
    assert out.count() == 2 and len(seen()) == 1
    common.dropped(out)
    assert not seen()


# 1 secrets


def brute_spans(text):
    kinds = [
        ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, rx, ok) in enumerate(kinds) for m in re.finditer(rx, text or "") if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


def test_secret_spans_equal_brute_force(spark):
    texts = [
        None, "", "token", "token=abc secret: token: abcdefgh", "💡 é PassWord = \"hunter22x\" 𝒳 token=ab", "AKIA" + "Z" * 16 + " AKIAAKIA", "0f" * 12 + "g" + "0" * 23,
        "api_key='deadbeefdeadbeefdeadbeef00' APIKEY:a.b-c_d/e+f=", "x" * 5000 + " secret=" + "q" * 300, "token==abcdef password:\n123456",
    ]
    got = secrets.annotate(docs(spark, list(enumerate(texts)))).select("doc_id", "spans", "u").collect()
    for r in got:
        base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "random"]
        assert base == brute_spans(texts[r["doc_id"]])
    assert secrets.annotate(docs(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, "token=abcdef", "b", "c", "d")], "doc_id long, text string, spans string, _text string, _base string")
    row = secrets.annotate(clash).first()
    assert (row["_text"], row["_base"], len(row["spans"])) == ("c", "d", 1) and secrets.redact(clash).first()["text"] == "[SECRET]"


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(letters, k=40)) for _ in range(20)]
    words = ["someCamelCaseIdentifier2", "zzzzzzzzzzzzzzzzzzzzzzzz1", "configuration_value_number_1", "internationalizationandmore"]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, f"see {w} here") for i, w in enumerate(words)]
    got = {r["doc_id"]: len(r["spans"]) for r in secrets.annotate(docs(spark, rows)).collect()}
    assert sum(got[i] for i in range(20)) >= 18 and not any(got[100 + i] for i in range(len(words)))


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
def test_tokens_of_letters_alone_are_found(spark, letters):
    rng = random.Random(letters)
    rows = [(i, f"see {''.join(rng.choices(letters, k=rng.choice([20, 24, 32, 40])))} here") for i in range(40)]
    words = ["donaudampfschifffahrtsgesellschaft", "otorhinolaryngologischesinstitut", "someVeryLongCamelCaseIdentifierName", "ANOTHERVERYLONGCONSTANTNAME", "z" * 24, "xy" * 15]
    got = {r["doc_id"]: len(r["spans"]) for r in secrets.annotate(docs(spark, rows + [(100 + i, w) for i, w in enumerate(words)])).collect()}
    assert sum(got[i] > 0 for i in range(40)) >= 36 and not any(got[100 + i] for i in range(len(words)))


def test_redaction_leaves_the_rest(spark):
    rows = [(1, "a token=abcdef1 b"), (2, "clean"), (3, None), (4, "token=" + "0f" * 20 + " é AKIA" + "A" * 16)]
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows)).collect()} == {1: "a [SECRET] b", 2: "clean", 3: None, 4: "[SECRET] é [SECRET]"}


def test_op1_digest(spark):
    for r in secrets.op1_secrets(spark, SF).collect():
        base = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()


# 2 decontamination


def test_substituted_items_are_found(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    off = lambda *at: " ".join("zz" if i in at else w for i, w in enumerate(words))
    rows = [(1, f"before {item} after"), (2, "x " + off(3, 11, 20).upper()), (3, "nothing of it"), (4, None), (5, ""), (6, " ".join(words[:6])), (7, f"{item} {item}"), (7, f"{item} {item}")]
    bench = spark.createDataFrame([(0, item, 1), (1, "a b", 1), (2, None, 1), (3, "p q r s t u", 1)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): (r["at"], r["matched"]) for r in decontaminate.overlaps(docs(spark, [*rows, (8, "p q r s t u")]), bench).collect()}
    assert got == {(1, 0): (1, 30), (2, 0): (1, 27), (7, 0): got[7, 0], (8, 3): (0, 6)}
    shuffled = decontaminate.overlaps(docs(spark, rows), bench, broadcast_rows=0)
    assert {r["doc_id"] for r in shuffled.collect()} == {1, 2, 7}
    assert decontaminate.overlaps(docs(spark, []), bench).count() == decontaminate.overlaps(docs(spark, rows), bench.limit(0)).count() == 0


def test_every_alignment_down_to_the_coverage_is_found(spark):
    """Against brute force: every fifth, third or second word, and random ones, substituted."""
    rng = random.Random(7)
    items = {k: [f"i{k}w{j}" for j in range(n)] for k, n in enumerate((7, 11, 13, 15, 16, 25, 38, 59))}
    rows = []
    for words in items.values():
        gone = [set(range(k - 1, len(words), k)) for k in (5, 3, 2)] + [set(rng.sample(range(len(words)), int(len(words) * r))) for r in (0.3, 0.4, 0.5, 0.5, 0.6)]
        for off in gone:
            rows.append((len(rows), "a b c " + " ".join(f"z{rng.random()}".replace(".", "") if i in off else w for i, w in enumerate(words)) + " d"))
    want = set()
    for i, text in rows:
        said = text.split()
        for k, words in items.items():
            most = max(sum(0 <= s + j < len(said) and said[s + j] == w for j, w in enumerate(words)) for s in range(-len(words), len(said)))
            if most * 2 >= len(words) and most >= min(7, len(words)):
                want.add((i, k, most))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    for limit in (2_000_000, 0):
        assert {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.overlaps(docs(spark, rows), bench, broadcast_rows=limit).collect()} == want
    assert decontaminate.tile_length(0.5, 7) == 6 and len(decontaminate.triples(6)) == 10


# 3 and 9 against SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df, cur = registry.QUERIES[name](spark, SF), con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) == want


def test_licenses_in_other_spelling(spark):
    other = "Copyright (c) 2020 Someone\n" + licenses.MIT.upper().replace("SUBLICENSE", "sub-license").replace(",", " ;")
    got = licenses.scan(docs(spark, [(1, other), (2, "intro\n\nReleased under the MIT Licence\nmore"), (3, None), (4, "MIT"), (5, "")])).collect()
    assert sorted((r["doc_id"], r["license"], r["unit"]) for r in got) == [(1, "MIT", "text"), (2, "MIT", "line")]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_copyright_lines_are_left_out_and_wrapped_sentences_are_not(spark):
    import textwrap

    wrapped = "\n\n".join(textwrap.fill(p, 60) for p in licenses.MIT.split("\n\n"))
    at_copyright = licenses.MIT.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    heads = ["Copyright (c) 2019 A B\n\n", "# Copyright 2019-2021 A B. All rights reserved.\n", "(c) 2020 A B\nAll rights reserved.\n\n", "/* Copyright \u00a9 A B */\n", "MIT License\r\n\r\nCopyright (c) 2020 <b>\r\n\r\n"]
    rows = [(i, h + t) for i, (h, t) in enumerate((h, t) for h in heads for t in (wrapped, at_copyright))]
    rows += [(100, "\n".join(f" * {x}" for x in wrapped.split("\n"))), (101, licenses.MIT.replace("\n", "\r\n")), (102, licenses.MIT[:-1] + " really"), (103, "x " + licenses.MIT)]
    got = {(r["doc_id"], r["license"], r["unit"]) for r in licenses.scan(docs(spark, rows + rows[:1])).collect()}
    assert got == {(i, "MIT", "text") for i in [*range(10), 100, 101]}


def test_licenses_beyond_the_lines_of_the_test_documents(spark):
    text = lambda name: (licenses.TEXTS / f"{name}.txt").read_text("utf-8")
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib"]
    rows = [(f"Copyright 2020 Someone\n{text(n)}", n, "text") for n in names]
    rows += [(f"# SPDX-License-Identifier: {i}\nx = 1", i, "line") for i in ("GPL-2.0", "BSD-3-Clause", "GPL-3.0-or-later", "AGPL-3.0-only", "CC-BY-NC-ND-4.0")]
    rows += [("x\n\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n\ny", "GPL-2.0", "block")]
    got = licenses.scan(docs(spark, [(i, t) for i, (t, _, _) in enumerate(rows)])).collect()
    best = {}
    for r in got:
        best.setdefault(r["doc_id"], set()).add((r["license"], r["unit"]))
    assert best == {i: {(name, unit)} for i, (_, name, unit) in enumerate(rows)}
    forms = licenses.known_digests(spark, licenses.KNOWN)
    assert forms.count() == forms.select("digest").distinct().count() > 900


def test_list_entries_hold_between_their_dates(spark):
    log = spark.sql("""SELECT * FROM VALUES ('block', 'a.example', 'add', DATE '2024-01-02'), ('block', 'a.example', 'remove', DATE '2024-01-04'),
      ('block', 'example', 'add', DATE '2024-01-04'), ('allow', 'a.example', 'add', DATE '2024-01-05') AS t(list, pattern, action, happened)""")
    caps = spark.sql("""SELECT * FROM VALUES (1, 'http://a.example/x', DATE '2024-01-01'), (2, 'http://a.example/x', DATE '2024-01-02'), (3, 'http://a.example/x', DATE '2024-01-04'),
      (4, 'http://u@A.example:80/x', DATE '2024-01-06'), (5, NULL, DATE '2024-01-06'), (6, 'no address', DATE '2024-01-06'), (7, 'http://a.example/x', NULL) AS t(page_id, url, fetched_at)""")
    want = {1: "none", 2: "block", 3: "block", 4: "allow", 5: "none", 6: "none", 7: "none"}
    for limit in (1_000_000, 0):
        assert {r["page_id"]: r["verdict"] for r in urlfilters.judge(caps, log, broadcast_entries=limit).collect()} == want
    again = urlfilters.judge(caps.union(caps).withColumn("host", F.lit("mine")).withColumn("row", F.lit("r")).withColumn("t", F.lit("u")), log)
    assert again.count() == 14 and again.columns == ["page_id", "url", "fetched_at", "row", "t", "host", "verdict", "pattern", "valid_from"]
    assert again.where("page_id = 2 AND verdict = 'block' AND host = 'a.example' AND row = 'r' AND t = 'u'").count() == 2
    assert urlfilters.judge(caps.limit(0), log).count() == 0 and urlfilters.judge(caps, log.limit(0)).where("verdict <> 'none'").count() == 0


# 4 images


def test_copies_are_found_and_flat_images_are_not(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(0, 41)]
    rows += [(41, rows[0][1]), (41, rows[0][1]), (60, [0.0] * 64), (80, None), (None, rows[3][1]), (100, rows[20][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    images = imagecopies.rendered(vectors)
    asked = imagecopies.edited(imagecopies.rendered(vectors.where("vec_id % 20 = 0")))
    key = lambda df: {(r["query_id"], r["image_id"]): r["members"] for r in df.collect()}
    # 41 is there twice, 100 is 20 and has been edited in the same way or another
    want = {(0, 0): 3, (20, 20): 2, (40, 40): 1, (100, 20): 2}
    assert key(imagecopies.copies(asked, images)) == want == key(imagecopies.copies(asked, images.withColumn("query", F.lit(1)), block=60))
    bad = spark.createDataFrame([(1, None, 1, 1), (2, bytearray(b""), 0, 0), (3, bytearray(b"abc"), 9, 9), (4, bytearray(b"x" * 441), 21, 21)], "id long, pixels binary, width int, height int")
    assert imagecopies.copies(bad, images).count() == 0 and imagecopies.copies(asked, images.limit(0)).count() == 0 == imagecopies.copies(bad, bad).count()


@pytest.mark.parametrize("kind", imagecopies.EDITS)
def test_recall_of_edits_against_brute_force(kind):
    """At least 0.9 of the copies have four matches within the radius in some table, as comparing all
    descriptors of a pair finds for them; all pairs of corners are compared, without Spark."""
    rng = np.random.default_rng(9)
    i, j = np.mgrid[:24, :24]
    found = brute = 0
    for n in range(40):
        v = rng.normal(size=64)
        grey = v[(i * 7 + j * 13) % 64] * v[(i * 11 + j * 5 + 1) % 64] + 0.3 * v[(i * 3 + j) % 64]
        image = np.rint((grey - grey.min()) / np.ptp(grey) * 255).astype(np.uint8).repeat(4, 0).repeat(4, 1)
        q, b = imagecopies.describe(imagecopies.edit(image, kind, n)[None], imagecopies.FINE), imagecopies.describe(image[None], imagecopies.STEP)
        q_bits, b_bits = (np.unpackbits(f[5], axis=1) for f in (q, b))
        near = (q_bits[:, None] != b_bits[None]).sum(2) <= 48
        met = np.any([(q_bits[:, c][:, None] == b_bits[:, c][None]).all(2) for c in imagecopies.CHOSEN], axis=0)
        brute += (near.any(1).sum() >= 4)
        found += ((near & met).any(1).sum() >= 4)
    assert brute >= 36 and found >= 36


# 5 packing


def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = [None, "", "It's a <|endoftext|> test", "Ünï çödé\x85x 日本 é", *("word%d " % i * (i * 37 % 900) for i in range(60))]
    rows = list(enumerate(texts))
    out = packing.pack(docs(spark, rows).repartition(5), packing.tokenizer_path(), fan_in=2, open_windows=3).collect()
    for i, text in rows:
        own = sorted((r["start"], bytes(r["ids"])) for r in out if r["doc_id"] == i)
        ids = np.frombuffer(b"".join(b for _, b in own), "<u4").tolist()
        assert ids == [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        assert [s for s, _ in own] == [0, *itertools.accumulate(len(b) // 4 for _, b in own)][: len(own)]
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(used) * 2048 - total < 2048 + 16 * len(used)
    assert packing.pack(docs(spark, []), packing.tokenizer_path()).count() == 0


# 6 language


def test_pages_of_known_language(spark):
    sentences = {"en": "the cat and the dog with that other thing ", "de": "der hund und die katze mit dem anderen ding ", "fr": "le chien et la souris avec une autre chose "}
    labelled = spark.createDataFrame([(s * 3 + str(i), lang) for lang, s in sentences.items() for i in range(20)], "text string, lang string")
    pages = [(i, f"http://{lang}.example/{i}", f"<html lang={lang}><p>{s}</p></html>") for i, (lang, s) in enumerate(sentences.items())]
    pages += [(9, None, None), (10, "http://de.example/x", ""), (11, "http://en.example/y", "<script>der die das und</script>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["lang"] for r in language.identify(df, labelled).collect()}
    assert [got[i] for i in range(3)] == list(sentences) and len(got) == 6 and got[10] == "de" and got[11] == "en"
    assert language.identify(df.limit(0), labelled).count() == 0
    assert {r["lang"] for r in language.identify(df, labelled.limit(0)).collect()} == {None}


def test_language_of_texts_that_were_not_learned(spark):
    """Held-out accuracy: texts of the table by halves, as pages that declare nothing on hosts of their own."""
    texts = [(r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r["lang"] and len(r["text"] or "") > 60]
    learned = spark.createDataFrame([t for i, t in enumerate(texts) if i % 2], "lang string, text string")
    asked = [(i, f"http://h{i}.example/", f"<html><body><p>{t[1]}</p></body></html>") for i, t in enumerate(texts) if i % 2 == 0]
    pages = spark.createDataFrame([*asked, asked[0], (-1, None, "x" * 500_000), (-2, None, None), (None, "no address", "")], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("p", F.lit(1))
    got = language.identify(pages, learned).collect()
    assert len(got) == len(asked) + 4 and all(0 <= r["probability"] <= 1 for r in got)
    named = {r["page_id"]: r["lang"] for r in got if r["page_id"] is not None and r["page_id"] >= 0}
    assert sum(named[i] == texts[i][0] for i, *_ in asked) >= 0.95 * len(asked)


def test_rare_declared_languages_are_evidence(spark):
    """A code that is not among the 200 with most pages, on a page without text."""
    en, de = "the cat and the dog with that other thing ", "der hund und die katze mit dem anderen ding "
    labelled = spark.createDataFrame([(s * 3 + str(i), lang) for lang, s in (("en", en), ("de", de)) for i in range(20)], "text string, lang string")
    codes = [a + b for a in "abcdefghij" for b in "abcdefghijklmnopqrstuv"]
    declared = [(c, en * 3) for c in codes for _ in range(6)] + [("qq", de * 3)] * 4 + [("qq", "")]
    pages = [(i, f"http://h{i}.s{i}x/", f"<html lang={c}><p>{t}</p></html>") for i, (c, t) in enumerate(declared)]
    got = {r["page_id"]: r["lang"] for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled).collect()}
    assert len(got) == len(pages) and got[len(pages) - 1] == "de" and got[0] == "en"


# 7 resharding


def test_flow_moves_the_least():
    rng = random.Random(1)
    for _ in range(30):
        supply, n = [rng.randint(0, 6) for _ in range(3)], 3
        capacity = [sum(supply) // n + (j < sum(supply) % n) for j in range(n)]
        cost = lambda i, j: 0 if i == j else 1
        flow = resharding.least_moves(supply, capacity, cost)
        assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(3)] == supply
        assert all(sum(x for (_, j), x in flow.items() if j == k) <= capacity[k] for k in range(n))
        assert sum(x for (i, j), x in flow.items() if i != j) == sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity))


def test_shards_are_even_and_slots_gapless(spark, tmp_path):
    rows = [(i, "same" if i % 3 == 0 else None if i % 50 == 1 else f"text {i} " * (i % 17)) for i in range(600)]
    out = resharding.reshard(docs(spark, rows, "doc_id long, text string, a string, b long, c string"), F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(6)), 8).cache()
    per = out.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).collect()
    assert len(per) == 8 and all(r["n"] == r["m"] + 1 == r["d"] for r in per)
    assert max(r["s"] for r in per) - min(r["s"] for r in per) <= 400
    assert out.groupBy("text").agg(F.count_distinct("shard").alias("k")).where("k > 1").count() == 0
    assert resharding.reshard(docs(spark, []), F.lit(0), 8).count() == 0
    touched = resharding.rewrite(out, str(tmp_path / "shards"), rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda df: sorted((r["shard"], r["slot"], r["doc_id"], r["text"] or "") for r in df.collect())
    assert {6, 7} <= set(touched) and key(back) == key(out.where(F.col("shard").isin(touched)))


def test_blocks_move_no_more_bytes_than_they_must():
    rng = random.Random(8)
    for _ in range(20):
        olds, shards = rng.randint(1, 7), rng.randint(1, 9)
        blocks = [(o, p, rng.choice([1, 5, 40, 300, 2000])) for o in range(olds) for p in range(rng.randint(0, 60))]
        placed = resharding.place_blocks(blocks, shards)
        supply, final, moved = [0] * max(olds, shards), [0] * max(olds, shards), 0
        for o, p, size in blocks:
            j = placed[o, p]
            supply[o] += size
            final[j] += size
            moved += size * (o != j)
        # the sizes reached can't be had from these supplies by moving less
        assert moved == sum(max(0, s - f) for s, f in zip(supply, final)) and sum(final[:shards]) == sum(supply)


def test_only_the_text_that_no_shard_holds_is_dealt(spark):
    rows = [(i, "hot " * 50) for i in range(3000)] + [(5000 + i, f"small {i % 3}") for i in range(900)] + [(None, "small 1"), (1, "hot " * 50), (9000, None)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, size int, part int")
    out = resharding.reshard(df, F.lit(0), 8, buckets=1)
    per = [r["s"] for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(per) == 8 and max(per) - min(per) < 0.03 * sum(per) and out.columns == ["doc_id", "text", "part", "size", "text_crc32", "old_shard", "shard", "slot"]
    spread = {r["text"]: r["k"] for r in out.groupBy("text").agg(F.count_distinct("shard").alias("k")).collect()}
    assert spread.pop("hot " * 50) == 8 and set(spread.values()) == {1} and out.where("part <> 8 OR size > 201").count() == 0


# 8 toxicity


def test_block_max_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(300):
        terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(terms))
        vectors.append((terms, w / np.linalg.norm(w)))
    index = toxicity.BlockMax(vectors, 40)
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:60]:
        q = np.zeros(40)
        q[t] = w
        sims = dense @ q
        kth = max(np.sort(sims)[-7], 1e-12)
        at, found = index.nearest(t, w, 7)
        assert set(index.order[at]) == set(np.flatnonzero(sims >= kth - 1e-9)) and np.allclose(np.sort(found), np.sort(sims[index.order[at]]))


def test_held_out_labels_are_not_used(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=20)) + (" awful rotten" if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    df = docs(spark, rows)
    fold = {r["doc_id"]: r["f"] for r in df.select("doc_id", toxicity.learns().alias("f")).collect()}
    label = lambda turned: spark.createDataFrame([(i, (i % 4 == 0) ^ (turned and not fold[i])) for i in range(400)], "doc_id long, b boolean").select("doc_id", F.col("b").cast("int").alias("label"))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(df, df, label(t)).collect()} for t in (False, True))
    assert a == b and len(a) == 402
    assert all((a[i] >= 0.3) == (i % 4 == 0) for i in range(400)) and a[900] == a[901] < 0.3
    assert {r["score"] for r in toxicity.score(df, df, label(False).limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), df, label(False)).count() == 0


# 10 near duplicates


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed, size, passage", [(1, 30, 12), (2, 60, 45), (3, 14, 0)])
def test_components_equal_brute_force(spark, seed, size, passage):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(passage)]
    rows, n = [], 0
    for family in (1, 1, 2, 3, 9, 40):
        base = common + [word() for _ in range(size)]
        for _ in range(family):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[: -rng.randrange(1, 6)]
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n + i, " ".join(common + [word() for _ in range(rng.randrange(3, 30))])) for i in range(60)]
    n += 60
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "a b"), (n + 4, "A  b"), (n + 5, "a b c"), (n + 6, rows[0][1]), (n + 7, "é É x y z"), (n + 8, "é é x y z")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearset.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_tables(spark):
    assert nearset.near_duplicates(docs(spark, [])).count() == 0
    rows = [(None, "one two three four five six"), (3, "one two three four five six"), (3, "one two three four five six"), (4, None)]
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in nearset.near_duplicates(docs(spark, rows)).collect())
    assert got == [("3", 2, "3"), ("3", 2, "3"), ("4", 0, "4"), ("None", 2, "None")]


def test_votes_count_against_their_own_band(spark):
    """Own votes of the native band (slack 10, of which 8 may be used) and a representative's
    vote in the next band, whose slack is larger: the pair must still be verified."""
    row = lambda kind, a, b, votes, subset, slack, other, band, native: (kind, a, b, votes, subset, slack, other, band, native, 90)
    rows = [row(0, 1, 2, 3, 0, 10, 10, 4, False), *(row(2, n, 0, 0, 7, 20, 0, 5, False) for n in (1, 2))]
    used = [(n, band, u, slack, 90) for n in (1, 2) for band, u, slack in ((4, 8, 10), (5, 12, 20))]
    found = spark.createDataFrame(rows, nearset.FOUND_SQL)
    got = nearset._voted(found, spark.createDataFrame(used, "a long, band int, used long, slack int, size long")).collect()
    assert [(r["a"], r["b"], r["kind"]) for r in got] == [(1, 2, 0)]


@pytest.mark.parametrize("seed, size", [(11, 92), (12, 60), (13, 138)])
def test_families_in_the_upper_half_of_a_band(spark, seed, size):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(4):
        base = [word() for _ in range(size)]
        for _ in range(30):
            text = list(base)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text[: len(text) - rng.randrange(4)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearset.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)
