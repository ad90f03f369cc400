"""Spelling variants, fill-in-middle and languages against plain versions; what pages show."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeed.llm import bpe_codec, fill_middle, html_text, language_id, license_scan, queries, spelling

SF = "/root/testdata/sf0.01"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("lang", "id", "n", "h", "some", "word", "run", "form", "key"))])
LONG = " ".join(f"word{k % 977} Tail{k}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (4, "a b c"), (None, "x y"), (None, None), (5, LONG), (6, "日本語 テキスト é ß\x00 x"), (7, "a <P> b"), (8, "x" * 100_000), (9, "ÿÿÿ ñandú Straße")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "fr", *["clash"] * 8) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# 11: spelling variants
def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts, ratio=2):
    form, beside = {}, {}
    for w in counts:
        close = [x for x in counts if near(w, x)]
        beside[w] = len(close)
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, beside[w], counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def test_near_pairs_equal_all_pairs():
    rng = np.random.default_rng(3)
    for count, most, letters in ((1, 5, "ab"), (70, 4, "ab"), (300, 6, "abc"), (150, 12, "aé日\x00"), (3, 0, "a")):
        words = sorted({"".join(rng.choice(list(letters), rng.integers(0, most + 1))) for _ in range(count)})
        i, k = spelling.near_pairs(words)
        assert sorted(zip(i.tolist(), k.tolist(), strict=True)) == [(a, b) for a in range(len(words)) for b in range(len(words)) if near(words[a], words[b])]


@pytest.mark.parametrize("slice_", [2, 5, 2048])
def test_variants_equal_all_pairs(spark, monkeypatch, slice_):
    monkeypatch.setattr(spelling, "SLICE", slice_)
    rng = np.random.default_rng(slice_)
    counts = {}
    while len(counts) < 220:
        w = "".join(rng.choice(list("abc"), rng.integers(0, 8)))
        counts[w] = int(2 ** rng.uniform(0, 12))
    counts |= {"y" * 90 + c + "y" * 40: n for c, n in (("a", 5), ("b", 11), ("", 30), ("ab", 70))}
    df = spark.createDataFrame([*counts.items(), ("zz", None), (None, 3)], "word string, n long")
    out = spelling.group_variants(df.withColumns({"form": F.lit("x"), "key": F.lit("x"), "root": F.lit(1)}))
    assert sorted(tuple(r) for r in out.collect()) == grouped(counts)


def test_variant_query_on_part_of_the_words(spark, texts):
    counts = Counter()
    for k, t in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{k}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = {r.word: r for r in queries.QUERIES["op11_spelling_variants"](spark, SF).collect()}
    assert {w: r.n for w, r in got.items()} == known
    by = {}
    for w in known:
        for i in range(len(w)):
            by.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    for w in sorted(known)[::40]:
        close = {x for i in range(len(w)) for x in by[i, w[:i], w[i + 1 :]]} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {x for i in range(len(w) + 1) for (j, a, b), xs in ((k, by.get(k, ())) for k in [(i, w[:i], w[i:])]) for x in xs}
        close = {x for x in close if x in known and x != w}
        best = min(close, key=lambda x: (-known[x], x), default=None)
        form = best if best and known[best] >= 2 * known[w] else None
        assert (got[w].n_near, got[w].form) == (len(close), form)


def test_words_of_odd_tables(spark, odd):
    runs = Counter(r.word for r in spelling.word_runs(odd, slip_every=0).collect())
    assert runs["straße"] == 1 and runs["ñandú"] == 1 and runs["x" * 100_000] == 1 and "clash" not in runs
    assert spelling.group_variants(spelling.vocabulary(spelling.word_runs(odd.limit(0)))).collect() == []
    out = {r.word: r for r in spelling.group_variants(spelling.vocabulary(spelling.word_runs(odd, slip_every=0), least=1)).collect()}
    assert out["x" * 100_000].n_near == 0 and out["ñandú"].root == "ñandú"
    with pytest.raises(ValueError, match="circles"):
        spelling.group_variants(spelling.vocabulary(spelling.word_runs(odd)), ratio=1)


# 12: fill in the middle
def rearranged(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (len(units), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("size", [1, 1000, 1 << 20])
def test_fill_middle(spark, odd, texts, monkeypatch, size):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", size)
    made = fill_middle.fill_in_middle(odd.union(spark.createDataFrame([(k, t, *["q"] * 9) for k, t in list(texts.items())[:200]], DOCS)))
    back = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    want = Counter((k, *rearranged(k, t or ""), t or "") for k, t in [*ODD, *list(texts.items())[:200]])
    assert Counter(tuple(r) for r in back.collect()) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_fill_middle_splits_markers_at_their_borders(spark):
    rows = [(k, t) for k in range(200) for t in ("<<P", ">S><", "<M", "<P<S<M")]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = made.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(rows)


# 13: languages
def test_languages_of_held_out_texts(spark):
    found = queries.QUERIES["op13_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_tables(spark, odd):
    docs = spark.createDataFrame([(1000 + k, ("the quick brown fox and the dog " if k % 2 else "der schnelle braune fuchs und der hund ") * 3, "en" if k % 2 else "de", *["q"] * 8) for k in range(80)], DOCS)
    model = language_id.fit(docs)
    assert model.families == ["germanic"] and model.pairs == [("de", "en")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd.union(docs), model).collect()]
    assert len(got) == len(ODD) + 80
    kinds = {k: (lang, score) for k, lang, score in got}
    assert kinds[1] == kinds[2] == kinds[3] == ("und", 0.0) and kinds[8][0] in ("de", "en")
    assert language_id.predict(odd.limit(0), model).count() == 0
    with pytest.warns(UserWarning, match="fewer than two"):
        none = language_id.fit(odd.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(odd, none).collect()} == {("und", 0.0)}
    with pytest.warns(UserWarning, match="fewer than two"):
        one = language_id.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predict(docs, one).collect()} == {"en"}


def test_texts_are_measured_whole(monkeypatch):
    text = "Der Fuchs 12 läuft,  und läuft. " * 50
    whole = language_id.measure(text)
    assert np.isclose((whole**2).sum(), 1) and not language_id.measure("12 - 3").any() and not language_id.measure("").any()
    for step in (1, 7, 64):
        monkeypatch.setattr(language_id, "STEP", step)
        assert np.allclose(language_id.measure(text), whole)


def test_families_are_told_apart_before_languages():
    rng = np.random.default_rng(1)
    centre = rng.random((4, language_id.BUCKETS)).astype(np.float32) / 40
    names = ["en", "de", "fr", "xx"]
    x = np.concatenate([c + rng.normal(0, 0.004, (40, language_id.BUCKETS)) for c in centre]).astype(np.float32)
    model = language_id.train(x, [n for n in names for _ in range(40)])
    assert model.families == ["=xx", "germanic", "romance"] and model.pairs == [("de", "en")]
    got, score = model.predict((centre + rng.normal(0, 0.004, centre.shape)).astype(np.float32))
    assert got == names and ((0 <= score) & (score <= 1)).all()


# 7: what pages show
def test_all_visible_text():
    page = html_text.page_text
    assert page("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>") == "x=1"
    assert page("<svg><defs/><title>t</title><text>LABEL</text><text>two</text></svg>after") == "LABEL\ntwo\nafter"
    assert page("<svg><defs><text>no</text></defs><circle r=1 /><text>yes</text></svg>") == "yes"
    assert page("a <select><option>one<option selected>two<option>three</select> b") == "a two b"
    assert page("<select><option disabled>pick<option>one</select>") == "one" and page("a<select></select>b") == "ab"
    assert page("<select multiple><optgroup label=G><option>x<option label=why>y</select>z") == "G\nx\nwhy\nz"
    assert page("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>tail") == "yes\ntail"
    assert page("<div style='display:none'>n<b style='visibility:visible'>x</b></div>a<p style='display:none;display:block'>b") == "a\n\nb"


def test_cells_that_reach_down():
    page = html_text.page_text
    assert page("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>") == "A  B\n   C\nD  E"
    assert page("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D<td>E</table>") == "A  B\n   C\n   D  E"
    assert page("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>") == "a  b  c\nd     e\nf     g\nh  i  j"


def test_tables_in_tables():
    page = html_text.page_text
    assert page("<ul><li><table><tr><td>a<td>b<tr><td>c<td><table><tr><td>i<td>j<tr><td>k</table></table><li>z</ul>") == "- a  b\n  c  i  j\n     k\n\n- z"
    assert page("<table><tr><td>a<br>b<br>c<td><p>x<p>y<tr><td>l<td>m</table>") == "a  x\nb\nc  y\nl  m"
    for html in ("<table><tr><td>x" * 20_000, "<table><tr><td>a<br>b<td>" * 20_000, "<table><tr><td>" + "q<br>" * 20_000 + "<td>" + "<table><tr><td>x<td>" * 10_000):
        began = time.process_time()
        text = page(html)
        assert time.process_time() - began < 8 and 20_000 <= len(text) < 10 * len(html)


# docstrings' promises on names, and what workers keep
def test_decoding_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, [72, 105], "x", "y"), (None, None, "x", "y"), (1, [], "x", "y")], "doc_id long, ids array<int>, data string, id string")
    got = bpe_codec.decode(df)
    assert got.columns == ["doc_id", "ids", "data"] and sorted(len(r.data) for r in got.collect())[:2] == [0, 0] and bpe_codec.decode(df.limit(0)).count() == 0


def test_identifiers_of_licences_by_themselves():
    label = lambda t: [d["label"] for d in license_scan.scan(t.encode(), *license_scan._rules(license_scan.SIGNATURES, ()))[1] if d["kept"]]
    assert (label("EPL-2.0"), label("(EPL-1.0)"), label("WTFPL"), label("mit dem Hund")) == (["epl-2.0"], ["epl-1.0"], ["wtfpl"], [])
