"""The corpus operators against libraries, SQL and brute force, on the test tables and on odd rows."""

import base64
import binascii
import glob
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from sparkfeed.llm import _shared, bpe_codec, byte_pairs, exact_dedup, html_text, license_scan, packing, probminhash, quality_mil, quality_rules, queries, token_counts, warc

SF = "/root/testdata/sf0.01"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("lang", "kept", "id", "n", "score", "measures"))])
LONG = " ".join(f"word{k % 977} Tail{k}" for k in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (None, "a b c d e f g h i j"), (None, None),
    (5, LONG), (6, "日本語 テキスト ǅ ﬁ é ß İ ½ \x1c \x85  x"), (7, "a<|endoftext|>b <|startoftext|>"), (8, "Released   under the\nMIT License."), (9, "x " * 3000), (10, "\r\n\r\n x"),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *["clash"] * 6) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def sql(query):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.execute(query).df()


def same(a, b):
    plain = lambda f: sorted((tuple(None if pd.isna(x) else x for x in r) for r in f[sorted(f.columns)].itertuples(index=False)), key=str)
    return sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF).toPandas(), sql(queries.ORACLE_SQL[name]))


# 1: licences
def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_license_scan(spark, odd, empty, texts):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    found = {r.doc_id: r for r in queries.QUERIES["op1_license_scan"](spark, SF).collect()}
    assert len(found) == len(texts)
    for k, text in texts.items():
        words = words_of(text)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = found[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert {x for _, x in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    out = license_scan.summary(license_scan.license_scan(odd)).collect()
    assert len(out) == len(ODD) and sum(r.n_base for r in out) == 3
    assert license_scan.license_scan(empty).count() == 0


def kept_labels(text):
    return [d["label"] for d in license_scan.scan(text.encode(), *license_scan._rules(license_scan.SIGNATURES, ()))[1] if d["kept"]]


def test_license_overlaps(spark):
    assert 300 <= len(license_scan._rules(license_scan.SIGNATURES, ())[0]) < 1000
    assert kept_labels("This is licensed under the GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"]
    assert kept_labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0"]
    assert kept_labels("see http://www.apache.org/licenses/LICENSE-2.0") == ["apache-2.0"]
    assert kept_labels("licensed under the GPL license") == ["gpl"] and kept_labels("licensed under the Frob license") == ["unknown-license"]
    assert kept_labels("nothing here of the kind") == []
    # the fuller rules stand beside the base phrases
    texts = ["license: cc-by-nc-sa-4.0", "Licensed under the Apache License, Version 2.0", "Released under the MIT License"]
    out = license_scan.summary(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert {r.doc_id: (r.base_labels, r.labels) for r in out} == {0: ("cc-by-nc", "cc-by-nc,cc-by-nc-sa-4.0"), 1: ("apache-2", "apache-2,apache-2.0"), 2: ("mit", "mit")}


def test_license_identifiers():
    assert kept_labels("Apache-2.0") == ["apache-2.0"] and kept_labels("Dual licensed under MIT or Apache-2.0") == ["mit", "apache-2.0"]
    assert kept_labels("GPL-3.0-or-later WITH Classpath-exception-2.0") == ["gpl-3.0", "classpath-exception-2.0"]
    assert kept_labels("(Apache-2.0 OR MIT)") == ["apache-2.0", "mit"] and kept_labels("license = 'BSD-3-Clause AND Zlib'") == ["bsd-3-clause", "zlib"]
    assert kept_labels("mit der Bahn, Python 2.0 and Unicode 3.0; isc or vim") == []


def test_license_texts():
    for text, label in (
        ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY", "mit"),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
        ("The Font Software may be sold as part of a larger software package but no copy of one or more of the Font Software typefaces may be sold by itself.", "bitstream-vera"),
        ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "wtfpl"),
        ("modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation", "gpl-2.0"),
    ):
        assert label in kept_labels(text), text


def test_license_overlaps_against_brute_force(texts):
    rules = license_scan.compile_rules()
    rng = random.Random(4)
    joined = [f" {' '.join(words_of(t))} ".encode() for t in texts.values()]
    found = [[(m.start(), m.end(), k, r) for k, r in enumerate(rules) for m in r.pattern.finditer(t)] for t in joined if b"licen" in t or b"permission" in t]
    found += [[(a, a + rng.randint(1, 12), k, rng.choice(rules)) for k, a in enumerate(rng.choices(range(40), k=rng.randint(1, 14)))] for _ in range(3000)]
    for detections in found:
        within = lambda d, e: e[0] <= d[0] and d[1] <= e[1]
        hint = lambda d: d[3].priority == license_scan.HINT
        better = lambda d, e: (e[3].priority, e[2]) < (d[3].priority, d[2])
        gone = lambda d, e: within(d, e) and (not hint(e) or hint(d)) and (e[:2] != d[:2] or better(d, e))
        left = [d for d in detections if not any(gone(d, e) for e in detections)]
        standing = []
        for d in sorted(left, key=lambda d: (d[3].priority, d[0] - d[1], d[0], d[2])):
            if not any(e[0] < d[1] and d[0] < e[1] and e[3].priority < d[3].priority for e in standing):
                standing.append(d)
        got = Counter((d["first_word"], d["end_word"], d["rule"]) for d in license_scan.resolve(detections) if d["kept"])
        assert got == Counter((a, b, r.name) for a, b, _, r in standing)


def spellings(pattern):
    """What a pattern allows: of a class of characters one, of repeats the fewest and one more."""
    from re import _constants as C
    from re import _parser as parser

    def one(op, arg):
        if op is C.LITERAL:
            return [chr(arg)]
        if op is C.BRANCH:
            return [x for part in arg[1] for x in row(part)]
        if op is C.SUBPATTERN:
            return row(arg[3])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, part = arg
            return ["".join(p) for n in range(low, min(high, low + 1) + 1) for p in product(row(part), repeat=n)]
        if op is C.IN:
            return ["q"] if (C.RANGE, (97, 122)) in arg else [chr(a if o is C.LITERAL else a[0]) for o, a in arg]
        if op is C.ASSERT:  # what must stand beside it is spelt out
            return row(arg[1])
        return [{C.NOT_LITERAL: "q"}[op]]

    def row(items):
        out = [""]
        for op, arg in items:
            out = [a + b for a in out for b in one(op, arg)]
        return out

    return row(parser.parse(pattern))


def test_license_gates_let_each_spelling_through():
    parts = license_scan._rules(license_scan.SIGNATURES, tuple(license_scan.BASE_PHRASES.items()))
    for rule in parts[0]:
        for s in spellings(rule.pattern.pattern.decode()):
            words = set(s.encode().split())
            assert rule.pattern.search(b" " + s.encode() + b" ") and not any(map(words.isdisjoint, rule.keywords)), (rule.name, s)
    # words that other licences' passages lack are few, and named
    assert {rule.label for rule in parts[0] if rule.context} == {"apache-2.0", "apache-1.1", "isc", "gpl-2.0", "gpl-3.0"}
    kept = lambda s: [d["label"] for d in license_scan.scan(s.encode(), *parts)[1] if d["kept"]]
    assert kept("Creative Commons Attribution-Share Alike 3.0 Unported") == ["cc-by-sa-3.0"]
    assert kept("Creative Commons Attribution-Non-Commercial 4.0") == ["cc-by-nc-4.0"]
    assert kept("licensed under the FreeBSD License") == ["bsd-2-clause"]
    assert kept("SPDX-License-Identifier: PSF-2.0") == ["python-2.0"]
    assert kept("the beerware license") == ["beerware"] and kept("Open RAIL-M license") == ["openrail"]
    # the same passage, in the licences that took it over
    assert kept("CDDL: You may not use this file except in compliance with the License.") == []


# 2: archives
def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://a b/c", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (None, "v", ""), (5, "w", "é\r\n\r\nWARC/1.1\r\n"), (5, "w", "é\r\n\r\nWARC/1.1\r\n"), (7, "z", "y" * 100_000)], "page_id long, url string, html string")
    back = {(r.source_id, r.warc_type, r.refers_id, r.payload_bytes, r.payload_digest) for r in warc.archive_pages(pages).collect() if r.warc_type != "warcinfo"}
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert back == {
        ("3", "revisit", "1", 8, sha("<p>x</p>")), ("1", "response", None, 8, sha("<p>x</p>")), ("2", "response", None, 0, sha("")), (None, "revisit", "2", 0, sha("")),
        ("5", "response", None, 16, sha("é\r\n\r\nWARC/1.1\r\n")), ("7", "response", None, 100_000, sha("y" * 100_000)),
    }
    assert warc.archive_pages(pages.limit(0)).count() == 0
    small = warc.archive_pages(pages, min_bytes=9).where("warc_type = 'revisit'").count()
    assert small == 0


def test_warc_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_shared, "FILTER_BITS", (8, 8))  # filters that tell next to nothing
    monkeypatch.setattr(_shared, "HOT_ROWS", 2)
    rng = random.Random(1)
    html = {k: "same" if k % 3 == 0 else rng.randbytes(3000).hex() for k in range(60)}
    rows = [(k, f"http://x/{k}", html[k], "q", 1, "q", "q") for k in html]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, refers_id int, warc_type string, error string").repartition(3)
    back = warc.archive_pages(pages, path=f"{tmp_path}/w", file_bytes=20_000).where("warc_type <> 'warcinfo'").collect()
    assert {int(r.source_id): (r.warc_type, r.refers_id, r.payload_bytes) for r in back} == {k: ("revisit", "0", 4) if k % 3 == 0 and k else ("response", None, len(t)) for k, t in html.items()}
    assert len(back) == 60
    whole = warc.read_warc(spark, f"{tmp_path}/w").where("warc_type = 'response'").collect()
    assert {int(r.source_id): r.payload.decode() for r in whole} == {k: t for k, t in html.items() if k % 3 or not k}
    files = glob.glob(f"{tmp_path}/w/part-*")
    assert len(files) > 6 and all(os.path.getsize(f) < 30_000 for f in files)
    data = open(max(files, key=os.path.getsize), "rb").read()
    members, rest = [], data
    while rest:  # each member is one record
        d = zlib.decompressobj(31)
        members.append(d.decompress(rest))
        rest = d.unused_data
    assert members[-1] == b"" and b"warcinfo" in members[0] and all(m.startswith(b"WARC/1.1\r\n") and m.count(b"WARC-Record-ID") == 1 and m.endswith(b"\r\n\r\n") for m in members[:-1])


def test_arc_formats():
    for version in (1, 2):
        body = warc.http_response(9, b"hello")
        data = warc.arc_version_block("f.arc", version, "19990131235959") + warc.arc_record("http://x/ y", "19990131", body, version, 5, "f.arc") + warc.arc_record("dns:x", "1999", b"ip", version, 9, "f.arc")
        info, page, dns = warc.read_arc("d/f.arc", data)
        assert (info["warc_type"], page["warc_type"], dns["warc_type"]) == ("warcinfo", "response", "resource")
        assert (page["target_uri"], page["warc_date"], page["payload"], page["source_id"]) == ("http://x/ y", "1999-01-31T00:00:00Z", b"hello", "9")
        assert dns["warc_date"] == "1999-01-01T00:00:00Z" and page["record_id"] != dns["record_id"]
        assert list(warc.read_arc("f", data[:-3]))[-1]["error"]
    assert "version" in next(warc.read_arc("f", b"nothing\n"))["error"]


# 3: quality rules
def test_quality_rules(odd, empty):
    out = quality_rules.quality_measures(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == len(ODD)
    by = {(r.doc_id, r.text): r for r in out.collect()}
    assert by[9, "x " * 3000]["measures_"].n_repeat_words == 3000 and by[1, None]["measures_"].n_words == 0
    assert quality_rules.keep_good(empty).count() == 0 and quality_rules.keep_good(odd).columns == odd.columns


def good(text):
    """The quality rules one text at a time, in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, windows = len(words), Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    if n < 20 or 100 * len(repeated) > 30 * n:
        return False
    chars, stop = sum(map(len, words)), {w.lower() for w in quality_rules.STOP_WORDS}
    latin = len(re.findall(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", quality_rules.OTHER_SCRIPTS), text)) <= 0.5 * chars
    return not (
        latin and not 2 * n <= chars <= 14 * n or latin and sum(w.lower() in stop for w in words) < 0.03 * n or len(re.findall(r"[#*$%&|<>]", text)) > 0.3 * n
        or len(lines) - len(set(lines)) > 0.5 * len(lines) or sum(x.endswith(("...", "…")) for x in lines) > 0.5 * len(lines)
        or sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines) > 0.95 * len(lines) or sum(len(w) > 1 and w.upper() == w != w.lower() for w in words) > 0.4 * n
    )


def test_quality_rules_against_plain_python(spark, odd, texts):
    more = {-1: "быстрая лиса прыгает через ленивую собаку у тихой реки " * 1 + " ".join(f"слово{k}ами" for k in range(30)), -2: "。".join(f"これは文{k}です 長い長い長い長い長い長い文です" for k in range(40)), -3: " ".join(f"xq{k}z" for k in range(60))}
    docs = spark.createDataFrame([*texts.items(), *more.items()], "doc_id long, text string")
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {k for k, t in (texts | more).items() if good(t)}
    assert good(more[-1]) and good(more[-2]) and not good(more[-3])
    assert Counter(r.doc_id for r in quality_rules.keep_good(odd).collect()) == Counter(k for k, t in ODD if good(t))


# 4: packing
def test_packing(spark, odd, empty, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for source, all_texts in ((spark.read.parquet(f"{SF}/documents.parquet"), list(texts.items())), (odd, ODD)):
        want = Counter()
        for k, text in all_texts:
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            want.update((k, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048)))
        got = rows_of(packing.pack(source))
        assert Counter(r[:5] for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r[5]].append((r[6], r[3]))
        total = 0
        for pieces in by.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
            total += at
        assert len(by) <= total / 2048 * 1.02 + 1
    assert packing.pack(empty).count() == 0


def best_fit(lengths, capacity):
    """Plain best-fit, longest first, one piece at a time: the room left in each sequence."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return sorted(rooms)


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(150):
        histogram = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
        by, ranks = defaultdict(list), defaultdict(list)
        for length, first, end, seq, offset, each in packing.plan(histogram, 64):
            for k in range(end - first):
                by[seq + k // each].append((offset + k % each * length, length))
                ranks[length].append(first + k)
        assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        for pieces in by.values():
            ends = 0
            for offset, length in sorted(pieces):
                assert offset == ends
                ends += length
        assert sorted(64 - sum(n for _, n in x) for x in by.values()) == best_fit([n for n, c in histogram.items() for _ in range(c)], 64)


# 5: exact duplicates
def test_exact_dedup(odd, empty):
    groups = defaultdict(list)
    for k, text in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), k is None, k or 0))
    out = exact_dedup.exact_duplicates(odd).collect()
    assert len(out) == len(ODD) and sum(r.kept for r in out) == len(groups)
    assert Counter(r.group_size for r in out) == Counter(len(g) for g in groups.values() for _ in g)
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(None if (m := min(g))[1] else m[2]) for g in groups.values())
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


# 6: quality classifier
def test_quality_mil(spark, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.QUERIES["op6_quality_mil"](spark, SF)
    assert out.count() == 1000
    tested = out.where("held_out").join(labels, "doc_id").toPandas()
    assert all(binascii.crc32(str(k).encode()) % 4 == 2 for k in tested.doc_id)
    assert (tested.predicted == tested.quality).mean() > 0.93
    model = quality_mil.fit(odd, labels.limit(0))
    assert {r.score_ for r in quality_mil.score(odd.select("doc_id", "text", "score"), model, columns=["doc_id", "score"]).collect()} == {0.5}
    assert quality_mil.score(odd, model).count() == len(ODD) and quality_mil.score(empty, model).count() == 0


def plain_score(model, text):
    """One text's score from its passages, step by step."""
    x, _ = quality_mil.encode_passages([text or ""])
    p, hidden, weight = model.p, [], []
    for row in (x - model.mean) / model.scale:
        h = np.tanh(row @ p["w"] + p["b"])
        hidden.append(h)
        weight.append(np.exp(np.clip((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"], -30, 30)))
    z = sum(w * h for w, h in zip(weight, hidden, strict=True)) / sum(weight)
    return float(1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))[0])


def test_scores_against_a_plain_forward_pass(spark, docs, texts, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_mil.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_mil.score(docs, model).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert abs(got[k] - plain_score(model, t)) < 1e-4, k
    kept = quality_mil.keep_quality(odd.withColumn("quality", F.lit(0)), labels)
    assert kept.columns == [*odd.columns, "quality"] and kept.count() <= len(ODD)
    model = quality_mil.fit(odd, labels)
    want = Counter(k for k, t in ODD if plain_score(model, t) >= quality_mil.THRESHOLD)
    assert Counter(r.doc_id for r in quality_mil.keep_quality(odd, labels).collect()) == want
    assert quality_mil.keep_quality(empty, labels).count() == 0 and quality_mil.keep_quality(odd, labels.limit(0)).count() == 0


def test_a_text_beyond_the_sample_leaves_the_others(spark):
    ids = spark.range(1, 81).select(F.col("id").alias("doc_id")).where(~quality_mil.held_out(F.col("doc_id")))
    first = ids.orderBy(F.xxhash64(F.lit("mil"), F.col("doc_id"))).first().doc_id
    text = F.when(F.col("doc_id") == first, F.repeat(F.lit("word "), 30_000)).when(F.col("doc_id") % 2 == 0, F.lit("the quiet river of the old town " * 20)).otherwise(F.lit("BUY ### $$$ now!!! 999 " * 20))
    docs = ids.withColumn("text", text).cache()
    labels = ids.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    model = quality_mil.fit(docs, labels, sample_passages=300)
    scores = {r.doc_id: r.score for r in quality_mil.score(docs.where(F.col("doc_id") != first), model).collect()}
    assert all((s > 0.5) == (k % 2 == 0) for k, s in scores.items())
    with pytest.warns(UserWarning, match="both classes"):
        quality_mil.fit(docs, labels, sample_passages=0)


def test_attention_gradient_learns_the_bad_passage():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, quality_mil.SIZE)).astype(np.float32)
    owner = np.repeat(np.arange(200), 3)
    y = (np.arange(200) % 2).astype(float)
    x[np.arange(200)[y == 1] * 3 + 1, :4] += 4
    model = quality_mil.train(x, owner, y)
    assert ((model.scores(x, owner, 200) > 0.5) == (y == 1)).mean() > 0.95


# 7: pages
def test_html_text(spark):
    page = html_text.page_text
    assert page("<ul><li>a<li>b<ol start=3><li>c</ol></ul>") == "- a\n- b\n  3. c"
    assert page("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>") == "Name       Qty\napple pie  3"
    assert page("<p>a  b<p>c<br>d<div style='display:none'>x</div><p hidden>y<script>z</script>") == "a b\n\nc\nd"
    assert page("<pre>  a\n   b</pre>tail &lt;") == "  a\n   b\n\ntail <".strip("\n")
    assert page("a<!-- b --><b") == "a<b" and page("") == "" and page("<td>x</td></p></div>") == "x"
    assert page("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    df = spark.createDataFrame([(1, None, "q"), (None, "<p>x", "q"), (1, "<p>y" * 20_000, "q")], "page_id long, html string, text string")
    assert sorted(len(r.text) for r in html_text.extract_text(df).collect()) == [0, 1, 59_998]
    out = queries.QUERIES["op7_html_text"](spark, SF).collect()
    assert len(out) == 250 and all("<p>" not in r.text and "track(" not in r.text for r in out)
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in out:  # brute force: strip what is hidden, then all tags; the words stay in their order
        plain = re.sub(r"<(head|script|style)\b.*?</\1>|<!--.*?-->", " ", html[r.page_id] or "", flags=re.S)
        plain = re.sub(r"<[^>]*>", " ", plain)
        import html as h

        assert re.sub(r"\s|- ", "", r.text) == re.sub(r"\s|- ", "", h.unescape(plain))


def test_html_text_takes_time_in_proportion_to_the_page():
    page = html_text.page_text
    many = [
        "<a b='x' " * 110_000, "<a " * 330_000, "<a b='x>y' " * 90_000, "<a '>" + "<a ' \" '>" * 80_000, "<!--" * 250_000, "</a" * 300_000,
        "<div>" * 100_000 + "</p>" * 100_000, "<blockquote>x" * 70_000, "<table><tr>" + "<td colspan=1000>a" * 50_000, "<tr><td colspan=9999><td>x" * 40_000, "<td>a<br>" * 100_000,
    ]
    for html in many:
        began = time.process_time()
        text = page(html)
        assert time.process_time() - began < 10 and len(text) < 10 * len(html), html[:20]


def test_html_text_hides_at_any_depth():
    page = html_text.page_text
    for tag in ("div hidden", "div style='display:none'", "noscript", "template", "svg><defs", "datalist"):
        for depth in (0, 600, 5000):
            ends = "".join(f"</{t.split()[0]}>" for t in reversed(tag.split("><")))
            out = page("<div>" * depth + f"a<{tag}>SECRET{ends}b" + "</div>" * depth + "c")
            assert out.split() == (["ab", "c"] if depth else ["abc"])
    assert page("<section>" * 700 + "<ul><li>x<li>y</ul>" + "<table><tr><td>a<td>b<tr><td>long<td>c</table>") == "- x\n- y\n\na     b\nlong  c"
    assert page("a <a x='1>2' y>b</a>c") == "a bc" and page("a <a x='1>2 y>b</a> c='") == "a 2 y>b c='" and page("a <b c='>d</b> e") == "a d e"


def test_html_text_on_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "<p>x", "q", "q"), (2, "", "q", "q")], "page_id long, html string, id string, text string")
    assert rows_of(html_text.extract_text(df).orderBy("page_id")) == [(1, "x"), (2, "")] and html_text.extract_text(df.limit(0)).count() == 0


# 8 and 10: byte pairs
def test_token_counts(spark, odd, empty, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda s: (len(s.encode()), len(t.encode(s, add_special_tokens=False).ids))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.QUERIES["op8_token_counts"](spark, SF).collect()}
    assert got == {k: count(s) for k, s in texts.items()}
    assert Counter(r[1:] for r in rows_of(token_counts.count_tokens(odd))) == Counter(count(s or "") for _, s in ODD)
    assert token_counts.count_tokens(empty).count() == 0


def test_bpe_codec(spark, odd, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op10_bpe_codec"](spark, SF).collect()}
    for k, s in texts.items():
        ids = library.encode_ordinary(s)
        assert got[k] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(s.encode()))
    back = bpe_codec.decode(bpe_codec.encode(odd)).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((s or "").encode() for _, s in ODD)
    assert Counter(tuple(r.ids) for r in back) == Counter(tuple(library.encode_ordinary(s or "")) for _, s in ODD)
    assert bpe_codec.encode(empty).count() == 0


def test_prefix_edits():
    e = byte_pairs.PrefixEncoder(byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.choice(b"abcetnoir") for _ in range(rng.randint(1, 40)))
        last = e.last_tokens(data)
        longer, more = e.append(data, last, b"tion")
        assert more == e.last_tokens(longer) and more[: len(last)] == last
        at = rng.randrange(len(data))
        edited, again = e.edit(data, last, at, at + 1, b"re")
        assert again == e.last_tokens(edited) and e.decode(e.ids(edited)) == edited


# 9: near duplicates
def classes(texts, threshold=0.8):
    """Brute force: all pairs that share a shingle, then connected components."""
    sets = {k: set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w := t.lower().split()) >= 5 else {tuple(w)} for k, t in texts.items()}
    at = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    shared = Counter()
    for ks in at.values():
        shared.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in texts}


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op9_probminhash"](spark, SF).collect()}
    want = classes(texts)
    assert {k: r.class_id for k, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[want[k]] and r.kept == (want[k] == k) for k, r in got.items())


def test_near_duplicates_odd(odd, empty):
    out = probminhash.near_duplicates(odd)
    assert out.count() == len(ODD)
    by = {(r.doc_id): r.class_id for r in out.collect()}
    assert by[8] == by[4] and by[1] == by[2] == by[3] == 1
    left = probminhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len({r.class_id for r in out.collect()})
    assert probminhash.near_duplicates(empty).count() == 0 and probminhash.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(5, text("a")), (5, text("b")), (6, text("b", 39)), (5, text("c")), (5, text("c", 39)), (None, text("d")), (None, text("d", 39)), (None, text("d", 38)), (None, text("e")), (7, text("e", 39))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r.doc_id, r.text[0]) for r in probminhash.drop_near_duplicates(docs).collect())
    assert left == Counter([(5, "a"), (5, "b"), (5, "c"), (None, "d"), (7, "e")])
    out = probminhash.near_duplicates(docs).collect()
    sizes = {r.class_key: r.class_size for r in out}
    assert sorted(sizes.values()) == [1, 2, 2, 2, 3] and Counter(r.class_key for r in out) == sizes


def test_near_duplicates_with_lines_repeated_in_one_copy(spark):
    texts = {}
    for k in range(24):  # half of the copies also lose words, to lie just above the threshold or just below it
        words = [f"t{k}w{i}" for i in range(300)]
        cut = 264 - 2 * k if k % 2 else 300
        texts[2 * k] = " ".join(words)
        texts[2 * k + 1] = " ".join(words[:cut]) + ("\n" + " ".join(words[60:160])) * (5, 30, 60, 100)[k // 2 % 4]
    want = classes(texts)
    assert 12 < sum(want[2 * k + 1] == 2 * k for k in range(24)) < 24
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()} == want
    assert {r.doc_id for r in probminhash.drop_near_duplicates(docs).collect()} == set(want.values())


def test_near_duplicates_at_a_lower_threshold(spark):
    texts = {1: "a b c d e f g", 2: "a b c d e f", 3: "h i j k l", 4: "h i j k l m", 5: "n o p q r", 6: "s n o p q r t"}
    for k in range(8):
        words = [f"t{k}w{i}" for i in range(200)]
        texts |= {10 + 2 * k: " ".join(words), 11 + 2 * k: " ".join(words[: 125 - 4 * k])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes(texts, 0.5)
    assert want[2] == 1 and want[4] == 3 and want[6] == 6 and want[11] == 10 and want[25] == 25
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs, threshold=0.5).collect()} == want


def test_hot_buckets_and_groups_are_dealt_without_loss(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_ROWS", 3)
    monkeypatch.setattr(probminhash, "BLOCK", 4)
    rng, base = random.Random(11), [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(90):  # one large group on both sides of the threshold, and copies of some of it
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            words[at] = f"e{k}x{at}" if k % 3 else f"e{k % 9}x{at}"
        texts[k] = " ".join(words)
    texts |= {100 + k: texts[k % 4] for k in range(40)} | {200 + k: " ".join(f"z{k}y{i}" for i in range(9)) for k in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes(texts)
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()} == want
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[t.replace(" ", "")].append(k)
    out = exact_dedup.exact_duplicates(docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in out} == {k: (min(g), len(g)) for g in groups.values() for k in g} and sum(r.kept for r in out) == len(groups)
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == sorted(min(g) for g in groups.values())


def test_blocks_make_each_pair_of_components_once(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_ROWS", 2)
    monkeypatch.setattr(probminhash, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(band, bytes([k]), bytes([rng.choice([0, 0, 0, 1, 2, k])]), 10, 10, [5, 5]) for band in range(6) for k in rng.sample(range(60), 4 + 9 * band)]
    df = spark.createDataFrame(rows, "band long, key binary, root binary, n int, s int, groups array<int>")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]}
    df = _shared.written(df, "rows")
    got = [(bytes(r.a), bytes(r.b)) for r in probminhash._across(df, probminhash._split(df), 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_spread_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_ROWS", 2)
    left = _shared.written(spark.createDataFrame([(k % 3 if k % 4 else None, k) for k in range(60)], "k int, v int"), "left")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, w string")
    for how in ("inner", "left"):
        plain, spread = left.join(right, "k", how), _shared.spread_join(left, right, "k", F.col("v"), how)
        assert Counter(rows_of(plain.select("k", "v", "w"))) == Counter(rows_of(spread.select("k", "v", "w")))


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    elements = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    w, v = rng.exponential(1, len(elements)) + 0.1, rng.exponential(1, len(elements)) + 0.1
    w[:100], v[300:] = 0, 0
    p = sum(1 / np.maximum(w / w[i], v / v[i]).sum() for i in range(len(elements)) if w[i] > 0 and v[i] > 0)
    m = 4096
    sig = [probminhash.signatures(elements[x > 0], x[x > 0], np.zeros((x > 0).sum(), np.int64), 1, m)[0] for x in (w, v)]
    assert abs((sig[0] == sig[1]).mean() - p) < 4 * (p * (1 - p) / m) ** 0.5 + 1e-9


def test_components(spark):
    pairs = [(bytes([0, a]), bytes([0, a + 1])) for a in range(40) if a not in (10, 25)] + [(b"\x01", b"\x02")]
    out = dict(rows_of(probminhash.components(spark.createDataFrame(pairs, "a binary, b binary")).select(F.hex("node"), F.hex("root"))))
    assert out["0005"] == "0000" and out["0019"] == "000B" and out["0028"] == "001A" and out["02"] == "01" and len(out) == 43


def test_bound_by_groups_is_never_below_what_texts_share(spark):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = {bytes([k]): np.unique(rng.choice(pool, int(rng.integers(1, 390)), replace=False)) for k in range(24)}
    # with all but a few of the same shingles, and with none that another text has
    sets[b"y"], sets[b"z"] = np.delete(sets[b"\x01"], 0), np.arange(5, dtype=np.uint64)
    sizes = probminhash._shared_sizes(spark.createDataFrame([(k, s.tobytes()) for k, s in sets.items()], "key binary, shingles binary")).collect()
    found = {bytes(r["key"]): r for r in sizes}
    assert found.keys() == sets.keys()
    for a, x in sets.items():
        others = np.concatenate([s for k, s in sets.items() if k != a])
        assert (found[a]["n"], found[a]["s"]) == (len(x), np.isin(x, others).sum()) and sum(found[a]["groups"]) == found[a]["s"]
        for b, y in sets.items():
            if a != b:
                assert np.minimum(found[a]["groups"], found[b]["groups"]).sum() >= len(np.intersect1d(x, y))


def test_near_duplicates_recall_on_queries(spark):
    """Ids divisible by 20 against all rows at ten times the size: pairs of set similarity 0.8 or more."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {k: {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for k, t in texts.items()}
    at = defaultdict(list)
    for k, found in sets.items():
        for x in found:
            at[x].append(k)
    pairs = set()
    for q in (k for k in texts if k % 20 == 0):
        shared = Counter(k for x in sets[q] for k in at[x] if k != q)
        pairs.update((q, k) for k, n in shared.items() if n >= 0.8 * (len(sets[q]) + len(sets[k]) - n))
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert len(pairs) > 200 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


# the pipeline
def test_pipeline(spark, docs, texts):
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, SF)
        if name != "best_fit_packing":
            assert rows.columns == docs.columns
            rows = rows.cache()
        ids, left = {r[0] for r in before.select("doc_id").collect()}, sorted(r.doc_id for r in rows.select("doc_id").collect())
        if name == "quality_rules":
            assert left == sorted(i for i in ids if good(texts[i]))
        if name == "quality_classifier":
            model = quality_mil.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = {i: plain_score(model, texts[i]) for i in ids}
            assert set(left) <= ids and all((i in left) == (s >= quality_mil.THRESHOLD) for i, s in scores.items() if abs(s - quality_mil.THRESHOLD) > 1e-4)
        if name == "exact_dedup":
            groups = defaultdict(list)
            for i in ids:
                groups["".join(re.findall(r"[^\x20\x09-\x0D]+", texts[i]))].append((-len(texts[i]), i))
            assert left == sorted(min(g)[1] for g in groups.values())
        if name == "near_dedup":
            assert set(left) == set(classes({i: texts[i] for i in ids}).values())
        if name == "best_fit_packing":
            assert set(left) == ids and rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert rows.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "near_dedup":  # its own tests have these rows
            out, none = stage(spark, odd, SF), stage(spark, empty, SF)
            assert out.columns == odd.columns and out.count() <= len(ODD) and none.columns == odd.columns and none.count() == 0
