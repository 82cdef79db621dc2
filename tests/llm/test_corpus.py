"""op1, op2, op3, op6, op9, op10 and the pipeline against SQL, brute force and held-out labels."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from keyspan.llm import ann, bradley_terry, divergence, html_extract, mixing, queries, simhash, sql
from keyspan.llm.components import components
from tests.llm.test_similar import kept_ids
from tests.oracle import connection, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, SF)) == rows_of_sql(connection(SF), queries.SQL[name])


# op1


def _vectors(n=3000, d=16, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, d)).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # one vector that many rows share
    return x


def test_neighbours_against_brute_force(spark):
    x = _vectors()
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank string")
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, ann.Settings(rows_block=300, queries_block=7)).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 50):
        scores = u @ u[q]
        scores[q] = -9
        best = np.lexsort((np.arange(len(x)), -np.round(scores, 12)))[:5]
        assert len(found[q]) == 5
        assert all(abs(s - scores[v]) < 1e-12 for v, s in found[q])
        hits += len({v for v, _ in found[q]} & set(best.tolist()))
    assert hits >= 0.9 * 5 * len(range(0, len(x), 50))
    assert [v for v, _ in found[0]] == [1000, 1001, 1002, 1003, 1004]


def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    u = np.array([r["embedding"] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    found = queries.op1_ann_adaptive_scan(spark, SF).collect()
    by = defaultdict(set)
    for r in found:
        by[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        scores = u @ u[i]
        scores[i] = -9
        hits += len(by[ids[i]] & set(ids[np.argsort(-scores)[:5]].tolist()))
        total += 5
    assert hits >= 0.9 * total


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (7, [0.0, 3.0])]
    found = ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 7, 0.0)]
    assert ann.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0


def test_scan_abandons_but_keeps_the_best():
    x = _vectors(4000, 64).astype(float)
    columns = [np.ascontiguousarray(x.T[c : c + 16]) for c in range(0, 64, 16)]
    hits = 0
    for q in range(20):
        kept = ann.scan(x[q] + 0.1, columns, np.arange(4000), 6, 2.1)
        exact = np.argsort(((x - x[q] - 0.1) ** 2).sum(1), kind="stable")[:6]
        hits += len(set(kept.tolist()) & set(exact.tolist()))
    assert hits >= 0.97 * 120
    first, splits = ann.packed(np.array([10, 5, 100, 3, 0]), 16)
    assert splits.tolist() == [1, 1, 7, 1, 1] and first[0] == first[1] and len({*first[2:4]}) == 2


# op2


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_bradley_terry(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)


def test_classifier_of_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (2, ""), (None, "word " * 50_000)], "doc_id long, text string",
    ).withColumn("score", F.lit("clash")).withColumn("good", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    rows = bradley_terry.quality(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    one_label = bradley_terry.quality(docs, labels.where("quality = 1")).collect()
    assert {(r["score"], r["predicted"]) for r in one_label} == {(0.5, 1)}
    assert bradley_terry.quality(docs.where("false"), labels.where("false")).count() == 0


def test_pairs_rank_by_strength():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((500, bradley_terry.WIDTH))
    good = (x[:, 0] + 0.1 * draw.standard_normal(500) > 0).astype(int)
    model = bradley_terry.fit(x, good)
    assert ((model.scores(x) >= 0.5) == good).mean() > 0.93
    assert np.abs(model.weights[0]) > 3 * np.abs(model.weights[1:]).max()


# op3

PAGES = [
    (
        "<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; line</h1><p>One.<p>Two&nbsp; \n "
        "three<br>four</article><footer>f</footer>", "Head & line\nOne.\nTwo three four",
    ),
    (
        "<div id=menu><ul><li><a>a</a><li><a>b</a></ul></div><div class=content><p>" + "long text " * 12 + "<div class='ad-box'>buy</div><p>end</div><div id=comments><p>" + "I think so too " * 12 + "</div>",
        ("long text " * 12).strip() + "\nend",
    ),
    ("<article><p>x<script>var a='</p><p>no';</script>y<!-- <p>no --><aside>no</aside><form>no</form></article>", "xy"),
    ("<p>&lt;b&gt; is <b>bold</b>, 1 < 2 &#233;</p>", "<b> is bold, 1 < 2 é"),
    ("", ""),
    ("<nav>only</nav>", ""),
    ("<article><p>open <script>never closed <p>no", "open"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def _runs(lengths, window):
    """Brute force: maximal stretches of places whose window holds text, with their highest window."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    out, i = [], 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j] > 0:
            j += 1
        if j > i:
            out.append((i, j, max(sums[i:j])))
        i = max(j, i + 1)
    return out


def test_curve_against_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(300):
        lengths = [float(x) for x in draw.choice([0, 0, 0, 5, 40, 300], draw.integers(0, 30))]
        window = int(draw.integers(1, 5))
        assert html_extract.runs(lengths, window) == _runs(lengths, window)
        surge = float(draw.choice([1, 80, 320]))
        kept = html_extract.kept_between(lengths, surge, window)
        assert kept == [x > 0 and any(a <= i < b and peak >= surge for a, b, peak in _runs(lengths, window)) for i, x in enumerate(lengths)]


def test_the_curve_decides_and_each_list_only_helps(spark, monkeypatch):
    import re

    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(120).collect()]
    whole = [html_extract.main_text(p) for p in pages]
    all_lines = ["\n".join(x.text for x in html_extract.lines(p) if not x.landmark) for p in pages]
    assert all(a != b for a, b in zip(whole, all_lines))  # without the curve adverts stay
    right = lambda texts: sum(a == b for a, b in zip(texts, whole)) / len(whole)
    unmarked = [re.sub(r"(</?)article\b", r"\1div", p) for p in pages]
    assert right(html_extract.main_text(p, words=frozenset()) for p in pages) > 0.9
    assert right(html_extract.main_text(p) for p in unmarked) > 0.9
    assert right(html_extract.main_text(p, words=frozenset()) for p in unmarked) > 0.9
    monkeypatch.setattr(html_extract, "LANDMARKS", frozenset())
    assert right(html_extract.main_text(p) for p in pages) > 0.9


def test_no_name_empties_an_article():
    for inside in (
        '<div class="tags-and-social-history"><p>A real paragraph</p></div>',
        '<section id="header-files"><p>A real paragraph</p></section>', '<div class="comments">A real paragraph</div>',
    ):
        assert html_extract.main_text(f"<nav>n</nav><article>{inside}</article><footer>f</footer>") == "A real paragraph"


def test_pages_with_parts():
    long = lambda w: " ".join([w] * 60)
    page = f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><section><p>{long('a')}</section><div class=ad>Buy now</div><section><p>end</section><section class=comments><p>So true</section></article><aside>{long('x')}</aside><div class=comments><p>{long('c')}</div>"
    assert html_extract.main_text(page) == f"Title\n{long('a')}\nend"
    bare = f"<div><ul><li><a href=x>{long('m')}</a></ul></div><div><h1>Title</h1></div><div><p>{long('a')}</p></div><div><p>short</p></div><div><p>{long('b')}</p></div><div><p>(c) x</p></div>"
    assert html_extract.main_text(bare) == f"Title\n{long('a')}\nshort\n{long('b')}"


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<p>x", "<a href=x>", '<div class="ad">y', "<i><p><b>", "<article>"])
def test_malformed_pages_take_linear_time(piece):
    import time

    def seconds(n):
        page = piece * n + "</p>" * n + "</i>" * n + "</div>" * n
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(100_000) < 20 * max(seconds(20_000), 0.05)


def test_surge_and_dive():
    assert html_extract.kept_between([5, 0, 0, 0, 60, 3, 70, 0, 0, 0, 4], 80) == [False] * 4 + [True] * 3 + [False] * 4


def test_pages_query_keeps_the_articles(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_html_line_blocks(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pages_of_odd_tables(spark):
    df = spark.createDataFrame(
        [(1, None, None), (1, None, None), (None, "u", "<p>" + "a b " * 100_000)], "page_id long, url string, html string",
    ).withColumn("text", F.lit("clash")).withColumn("id", F.lit(1))
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in html_extract.extract(df).collect()) == [(0, 399_999), (1, 0), (1, 0)]
    assert html_extract.extract(df.where("false")).count() == 0


# op6


def _repeat_words(words):
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    return len({p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)})


def test_counts_against_brute_force(spark):
    texts = [None, "", "a b c a b c", "a a a a", "x y", "one\n\none\n \none", "#tag $5 <b>", "é É 1 😀 z", " ".join("abc"[i % 3] for i in range(20_000))]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
    rows = {r["doc_id"]: r for r in divergence.quality_rules(df).collect()}
    import re

    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)),
            _repeat_words(words),
        ), t
        assert r["base_failed"] == (len(words) < 50 or 100 * _repeat_words(words) > 50 * len(words))
    assert divergence.quality_rules(df.where("false")).count() == 0
    assert divergence.kept_documents(df).columns == df.columns


def test_rules_leave_good_documents_and_reject_bad(spark):
    rows = queries.op6_divergence_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    kept = Counter((r["quality"], r["kept"]) for r in rows)
    assert kept[1, True] >= 0.99 * (kept[1, True] + kept[1, False])
    assert kept[0, False] >= 0.6 * (kept[0, True] + kept[0, False])


def test_rules_run_no_python(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    words = divergence.common_words(df)
    for plan in (words, divergence.measured(df, words), divergence.references(divergence.measured(df, words))):
        assert "Python" not in plan._jdf.queryExecution().executedPlan().toString() and "Arrow" not in plan._jdf.queryExecution().executedPlan().toString()


# op9


def _fingerprint(text, k):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, threshold):
    label = dict(zip(fps, fps))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = list(label)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= threshold:
                label[root(a)] = root(b)
    return {x: root(x) for x in keys}


def test_simhash_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: _fingerprint(t, 3) for i, t in docs.items()}
    root = _components(list(fps.values()), 2)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    rows = queries.op9_simhash(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", least[root[fps[r["doc_id"]]]])


@pytest.mark.parametrize("threshold", [0, 1, 2])
@pytest.mark.parametrize("crowd", [4, 1024])
def test_links_lose_no_component(spark, threshold, crowd):
    draw = np.random.default_rng(threshold)
    centres = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for c in centres.tolist():
        x = c
        for _ in range(60):  # chains and balls of near fingerprints
            x = (x if draw.random() < 0.5 else c) ^ sum(1 << int(b) for b in draw.integers(0, 64, draw.integers(0, 3)))
            fps.add(x)
    fps |= set(draw.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    linked = {r["node"]: r["component"] for r in components(simhash.fingerprint_links(df, threshold, crowd)).collect()}
    found, expected = defaultdict(set), defaultdict(set)
    for (f,) in signed:
        found[linked.get(f, f)].add(f % (1 << 64))
    for f, r in _components(sorted(fps), threshold).items():
        expected[r].add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_every_word_is_near_an_anchor():
    draw = np.random.default_rng(4)
    half = draw.integers(0, 1 << 32, 3000, dtype=np.uint32)
    at, anchor = simhash.anchors(half)
    apart = np.bitwise_count(half[at] ^ anchor)
    assert apart.max() <= 2 and len(np.unique(at[apart <= 1])) == len(half)
    assert len(set(zip(at.tolist(), anchor.tolist()))) == len(at)


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame(
        [(3, None), (2, ""), (9, " \n"), (4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (5, "z " * 100_000)], "doc_id long, text string",
    ).withColumn("fp", F.lit(1)).withColumn("component", F.lit(2))
    rows = simhash.near_duplicates(df).collect()
    by = sorted(((r["doc_id"] or -1), r["component_id"]) for r in rows)
    assert [b for b in by if b[0] in (2, 3, 9)] == [(2, 2), (3, 2), (9, 2)]
    assert [b for b in by if b[0] in (-1, 4)] == [(-1, 4), (4, 4), (4, 4)]
    assert simhash.near_duplicates(df.where("false")).count() == 0


# op10


def test_mix_meets_its_weights(spark):
    rows = [(i, "t", "big" if i % 3 else "small") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(df, {"big": 1.0, "small": 3.0}, epoch=2.0)
    n = Counter(r["source"] for r in out.collect())
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.02 and abs(sum(n.values()) - 12_000) < 500
    again = mixing.mixed(df.repartition(7), {"big": 1.0, "small": 3.0}, epoch=2.0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_draws_invert_the_distribution(spark):
    import math

    for rate in (0.01, 1.0, 30.0, 400.0):
        us = [0.0001, 0.3, 0.5, 0.9, 0.9999]
        found = [r["n"] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson_count(F.col("u"), F.lit(rate)).alias("n")).collect()]
        for u, n in zip(us, found):
            cdf = lambda k: sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1))
            assert u < cdf(n) and (n == 0 or u >= cdf(n - 1))


def test_mix_of_odd_tables(spark):
    df = spark.createDataFrame(
        [(1, None, None), (1, None, None), (None, "", "a"), (2, "x", "zero")] * 50, "doc_id long, text string, source string",
    ).withColumn("__docs", F.lit("clash")).withColumn("copy", F.lit(1))
    out = mixing.mixed(df, {"zero": 0.0})
    assert out.where("source = 'zero'").count() == 0 and out.where("source is null").count() > 0
    assert out.columns == df.columns
    clash = df.withColumns({"__copy": F.lit(7), "__key": F.lit(8), "a.b": F.lit(9), "__own": F.lit(1), "__rate": F.lit(2), "__id": F.lit(3)})
    named = mixing.mixed(clash, {}, copy_name="copy_no", key_name="key")
    assert named.columns == [*clash.columns, "copy_no", "key"] and {(r["__copy"], r["__key"], r["a.b"]) for r in named.collect()} == {(7, 8, 9)}
    with pytest.raises(ValueError, match="__copy"):
        mixing.mixed(clash, {}, copy_name="__copy")
    assert mixing.mixed(df.where("false"), {}).count() == 0
    rare = mixing.mixed(df, {}, max_sources=1)
    assert sorted(map(repr, rare.collect())) == sorted(map(repr, mixing.mixed(df, {}).collect()))


# pipeline


def test_components_of_a_long_path(spark):
    n = 500
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 1999)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {found[i] for i in range(n + 1)} == {0} and found[2000] == 1999 and 1000 not in found


def _drawn(rows):
    """How often each document is drawn, by an own inversion of the distribution."""
    import hashlib
    import math

    docs = Counter(r["source"] for r in rows)
    weight = {s: queries.MIX_WEIGHTS.get(s, 1.0) for s in docs}
    out = Counter()
    for r in rows:
        rate = len(rows) * weight[r["source"]] / (sum(weight.values()) * docs[r["source"]])
        u = (int(hashlib.md5(f"mix-1:{r['doc_id']}:1".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        n, p = 0, math.exp(-rate)
        c = p
        while u >= c:
            n += 1
            p *= rate / n
            c += p
        out[r["doc_id"]] += n
    return +out


def test_stages_carry_any_columns_and_rows(spark, tmp_path):
    """Clashing names, null and repeated ids, null and empty texts through all five stages."""
    draw = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    text = lambda: " ".join(draw.choice(words, 120))
    same = text()
    rows = [(None, text()), (None, text()), (7, same), (7, same), (8, same), (9, None), (10, ""), *((i, text()) for i in range(20, 60))]
    docs = spark.createDataFrame([(i, t, "en", f"src{k % 3}", 5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    odd = {"score": 99.0, "__copy": 1, "__key": 2, "a.b": 3, "own": 4, "row": 5, "rid": 6, "key": 7, "bucket": 8, "kept": 9, "place": 10}
    docs = docs.withColumns({k: F.lit(v) for k, v in odd.items()})
    spark.createDataFrame([(i, i % 2) for i in range(20, 60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        kept = now.collect()
        assert all(r[k] == v for r in kept for k, v in odd.items()), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        now = spark.createDataFrame(kept, docs.schema)
        if name == "quality rules":
            assert Counter(r["doc_id"] for r in kept) == Counter(i for i, t in rows if t)
        if name == "quality classifier":
            now, kept = docs.where("text <> ''"), None  # the next stage sees all the odd rows
        if name == "near duplicates":
            assert Counter(r["doc_id"] for r in kept) == Counter([None, None, 7, *range(20, 60)])
    out = corpus_pipeline.byte_level_bpe(spark, now.unionByName(docs.where("doc_id = 9")), str(tmp_path)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in out) and any(r["n_tokens"] == 0 for r in out)


def test_pipeline_leaves_no_scratch(spark, sf_dir, tmp_path, monkeypatch):
    from keyspan.sources import store

    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")  # a folder of this test's own
    out = corpus_pipeline.run(spark, sf_dir)
    left = store.children(spark, str(tmp_path))
    assert out.count() > 0 and [n.rsplit("-", 1)[0] for n in left] == ["byte-level-BPE"]


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        by_stage[name] = rows
        if name != "byte-level BPE":
            assert out.columns == before.columns
            docs = spark.createDataFrame(rows, out.schema)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in divergence.quality_rules(whole).where("kept").collect()}
    assert {r["doc_id"] for r in by_stage["quality rules"]} == kept
    one = [r for r in by_stage["near duplicates"]]
    assert sorted(r["doc_id"] for r in one) == kept_ids([(r["doc_id"], r["text"]) for r in by_stage["quality classifier"]])
    model = bradley_terry.fitted(spark.createDataFrame(by_stage["quality rules"], whole.schema), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    x = np.stack([bradley_terry.features((r["text"] or "").encode()).astype("<f4") for r in by_stage["quality rules"]]).astype(float)
    assert {r["doc_id"] for r in by_stage["quality classifier"]} == {r["doc_id"] for r, s in zip(by_stage["quality rules"], model.scores(x)) if s >= 0.5}
    assert Counter(r["doc_id"] for r in by_stage["source mix"]) == _drawn(one)
    assert Counter(r["doc_id"] for r in by_stage["byte-level BPE"]) == Counter(r["doc_id"] for r in by_stage["source mix"])
    assert {r["doc_id"] for r in by_stage["source mix"]} <= {r["doc_id"] for r in one}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(by_stage["byte-level BPE"])


def test_sql_is_registered_for_known_queries():
    assert set(queries.SQL) <= set(queries.QUERIES) and sql.OP6
