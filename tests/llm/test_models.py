"""Classifier, neighbours, chats, pages and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import ann, chat, html_text, labeller, rules
from sparkloom.llm.blocks_html import leaves
from sparkloom.llm.common import table
from sparkloom.llm.dartminhash import signatures
from tests.llm.fixtures import documents, empty, frame


def test_quality_on_held_out_labels(spark, sf_dir):
    got = {r.doc_id: r for r in rules.op3_quality(spark, sf_dir.replace("0.001", "0.01")).collect()}
    labels = [r for r in table(spark, sf_dir.replace("0.001", "0.01"), "labels").collect() if got[r.doc_id].held_out]
    assert len(got) == 1000 and len(labels) > 50
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_quality_on_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, _) in enumerate(documents())] + [(9999, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = rules.fit_quality(docs, labels)
    got = rules.score_quality(docs, model).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got) and got[0].block == "x"
    assert len({r.score for r in got if not r.text}) == 1
    stats, names = rules.with_statistics(docs)
    x = stats.select(*names).toPandas().to_numpy(float)
    assert np.allclose(sorted(model.predict(x)), sorted(r.score for r in got), atol=1e-6)
    none = rules.fit_quality(docs, labels.limit(0))
    assert {r.score for r in rules.score_quality(docs, none).collect()} == {0.5}
    assert rules.score_quality(empty(spark), model).collect() == []


def test_neighbours(spark, sf_dir):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x[:200] = x[0] + 0.05 * x[:200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(40)]  # many equal vectors
    rows += [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [float("nan")] * 24), (2080, [None] * 24), (2100, [1.0, 2.0]), (None, x[1].tolist()), (0, x[0].tolist())]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("bucket", F.lit("x")), F.col("vec_id") % 20 == 0, 20).collect()
    good = {i: np.array(v, float) for i, v in rows if i is not None and i < 2000}
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: r.rank):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == {i for i in good if i % 20 == 0}
    hit = 0
    for q, near in by.items():
        exact = {i: float(np.cumsum(good[q] * v)[-1]) for i, v in good.items() if i != q}
        want = sorted(exact, key=lambda i: (-exact[i], i))[:20]
        assert [r for r in near] == sorted(near, key=lambda p: (-p[1], p[0])) and len(near) == 20
        assert all(abs(exact[i] - s) < 1e-12 for i, s in near)
        hit += len(set(want) & {i for i, _ in near})
    assert hit >= 0.9 * 20 * len(by)
    few = ann.nearest(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 20).collect() == []


def neighbours_recall(spark, ids, x, k=20, every=20):
    """The share of the exact neighbours' scores that op4_ann's operator reaches, and the fewest rows of a query; rows of equal id count once."""
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    by = defaultdict(dict)
    for r in ann.nearest(rows, F.col("vec_id") % every == 0, k).collect():
        by[r.query_id][r.vec_id] = r.score
    hit = total = 0
    for q in (i for i in range(len(ids)) if ids[i] % every == 0):
        best = {}
        for i, s in zip(ids, x @ x[q], strict=True):
            if i != ids[q]:
                best[i] = max(s, best.get(i, -np.inf))
        want = sorted(best.values(), reverse=True)[:k]
        total += len(want)
        hit += sum(s >= want[-1] - 1e-9 for s in by[ids[q]].values())
    return hit / total, min(len(by[i]) for i in ids if i % every == 0)


def test_neighbours_of_unequal_norms_and_in_crowds(spark):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(2000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    one = unit.copy()
    one[7] *= 10
    crowd = unit.copy()
    crowd[:1000] = crowd[0] + 1e-3 * crowd[:1000]
    for x in (one, unit * np.exp(rng.normal(size=(2000, 1))), crowd, unit[:, :2]):
        recall, fewest = neighbours_recall(spark, np.arange(len(x)), x)
        assert recall >= 0.98 and fewest == 20


def test_neighbours_behind_an_id_of_many_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    ids = np.arange(400)
    ids[200:] = 7  # half of all rows
    x[200:] = x[0] * 2 + 0.1 * x[200:]
    ids[150:200], x[150:200] = 9, x[0]  # repeated rows
    assert neighbours_recall(spark, ids, x) == (1.0, 20)


def test_neighbours_of_odd_lengths_and_huge_vectors(spark):
    rows = [(i, [1e200 * (1 + i % 7), 1e200]) for i in range(12)] + [(20 + i, [float(i), 1.0, 2.0]) for i in range(5)]
    by = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3).collect():
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(by[0]) == [(i + 1, i + 1, float("inf")) for i in range(3)]
    assert sorted(by[20]) == [(1, 21, 5.0), (2, 22, 5.0), (3, 23, 5.0)]


def test_recall_on_the_given_vectors(spark, sf_dir):
    df = table(spark, sf_dir.replace("0.001", "0.01"), "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    dims = len(next(v for _, v in rows if v))
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == dims and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], float)
    got = defaultdict(set)
    for r in ann.op4_ann(spark, sf_dir.replace("0.001", "0.01")).collect():
        got[r.query_id].add(r.vec_id)
    hit = total = 0
    for q, i in enumerate(ids):
        if i % 20 == 0:
            score = np.where(ids == i, -np.inf, x @ x[q])
            want = ids[np.lexsort((ids, -score))][: min(20, len(ids) - 1)]
            hit, total = hit + len(got[i] & set(want.tolist())), total + len(want)
    assert total and hit / total >= 0.95


def test_neighbours_of_small_tables(spark):
    x = np.random.default_rng(6).normal(size=(101, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (15, 80, 81, 101):
        recall, fewest = neighbours_recall(spark, np.arange(n), x[:n], every=5)
        assert recall >= 0.98 and fewest == min(20, n - 1)


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_escapes(text):
    for t in (text, text.replace("|", "<|") + "<\\|", "<" + text):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_chats(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "<|im_end|>hi"), (1, 2, "assistant", "yes <\\| "), (1, 3, "user", None), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    rows += [(3, 0, None, "x"), (3, 1, "odd\n\\role", ""), (None, 0, "user", "u"), (None, None, "assistant", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x"))
    segments = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(segments).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and got[None].valid and not got[2].valid and not got[3].valid
    assert sum(len(r.text) for r in segments.collect()) == sum(r.formatted_chars for r in got.values())
    assert chat.read_chats(chat.format_chats(df.limit(0))).collect() == []


def test_leaves():
    page = '<!DOCTYPE html><head><title>t</title></head><body><p>a &amp; b<br>c<p>d <b>e</b><script>var x="</p>"</script><ul><li>f<li><a href="x>y">g</a></ul><!-- <p>no</p> --><div class="ad top">h &am i<table><tr><td>1<td>2</table>'
    assert [b.text for b in leaves(page)] == ["a & b c", "d e", "f", "g", "h &am i", "1", "2"]
    assert leaves(page)[4].path[-1] == ("div", "ad", "top") and leaves(page)[3].linked == 1
    assert leaves("") == [] and leaves("a < b > c")[0].text == "a < b > c"
    assert leaves("<p title='" + "x" * 10000)[0].text.startswith("<p title")


def test_pages(spark, sf_dir):
    body = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Über uns</h1><p>Lorem ipsum dolor sit amet, consectetur.</p><p>Second &quot;one&quot;.\n  Here</p></article><footer>&copy; all</footer>"
    rows = [(1, "u", body), (2, None, None), (3, "u", ""), (None, "u", "<p></p>"), (1, "u", body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.main_text(df).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted([("1", want := 'Über uns\n\nLorem ipsum dolor sit amet, consectetur.\n\nSecond "one". Here'), ("2", ""), ("3", ""), ("None", ""), ("1", want)])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(df.limit(0)).collect() == []
    model, right, total = labeller.trained(), 0, 0
    from sparkloom.llm.synthetic_pages import marked_pages

    for page in marked_pages(100, 77):
        blocks, main = labeller.labelled(leaves(page))
        right += int((model.label([blocks])[0] == (main > 0)).sum())
        total += len(blocks)
    assert right / total > 0.98


#: Pages as on the web, and their main text as a reader would copy it.
WRITTEN = (
    (
        "<html><head><title>Bread</title><style>p{}</style></head><body><header><a href='/'>The Oven</a><nav><ul><li><a href='/a'>Recipes</a></li><li><a href='/b'>About</a></li></ul></nav></header>"
        "<main><article><h1>Rye bread</h1><p>Mix flour, water and salt. Let the dough rest for a day.</p><p>Bake it for an hour &amp; let it cool.</p></article>"
        "<aside><h3>Popular</h3><ul><li><a href='/c'>Ten cakes</a></li></ul></aside></main><footer><p>&copy; 2020 The Oven. All rights reserved.</p></footer></body></html>",
        "Rye bread\n\nMix flour, water and salt. Let the dough rest for a day.\n\nBake it for an hour & let it cool.",
    ),
    (
        "<body><div class='cookie-notice'>We use cookies. <button>Accept</button></div><div id='content'><article><h2>Der Fluss</h2><p>Im Fr&uuml;hling steigt das Wasser<br>bis an die Br\u00fccke.</p>"
        "<noscript><img src=x><p>Im Sommer ist er fast trocken, und die Kinder spielen am Ufer.</p></article></div><div class='comments'><h4>Comments</h4><p class='comment'>Nice!</p></div></body>",
        "Der Fluss\n\nIm Fr\u00fchling steigt das Wasser bis an die Br\u00fccke.\n\nIm Sommer ist er fast trocken, und die Kinder spielen am Ufer.",
    ),
)


def test_pages_against_written_texts(spark, sf_dir):
    df = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(WRITTEN)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {i: text for i, (_, text) in enumerate(WRITTEN)}
    pages = table(spark, sf_dir, "pages").collect()
    found = {(r.page_id, r.url): r.text for r in html_text.op10_html(spark, sf_dir).collect()}
    want = {(r.page_id, r.url): "\n\n".join(b.text for b in leaves(r.html or "") if ("article",) in b.path) for r in pages}
    marked = [k for k in want if want[k]]
    assert set(found) == set(want) and np.mean([found[k] == want[k] for k in marked]) > 0.95  # these pages mark their articles; the labeller reads tags as hashes


def test_silent_elements_hide_only_what_they_hold():
    text = lambda page: [b.text for b in leaves(page)]
    assert text("<p>a</p><noscript><img src=x><p>one</p><p>two</p>") == ["a", "one", "two"]
    assert text("<p>a<svg><g><svg>x</svg>y</g></svg>b</p><object><object>q</object>r</object><p>c") == ["ab", "c"]
    assert text("<p>a<script>if (a < b) '<p>no</p>'") == ["a"]
    assert text("<head><title>t</title><p>a</p>") == ["a"] and text("<head><meta x><body><p>b") == ["b"]


def test_deep_and_long_pages(monkeypatch):
    deep = leaves("<div class=a>x" * 30_000 + "</div>" * 30_000)
    assert len(deep) == 30_000 and labeller.features(deep[-2000:], 28_000, 30_000).shape == (2000, labeller.WIDTH)
    page = leaves("<nav><a href=x>menu</a></nav><article>" + "".join(f"<p>Sentence number {i} of a long text.</p>" for i in range(700)) + "</article><footer>end</footer>")
    whole = labeller.trained().label([page])[0]
    monkeypatch.setattr(labeller, "LONG", 100)
    assert labeller.trained().label([page, page[:50]])[0].tolist() == whole.tolist() and whole.sum() >= 690


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    n = 400
    a, b = rng.uniform(0.2, 3, n), rng.uniform(0.2, 3, n)
    b[:300] = a[:300]
    element = rng.integers(0, 1 << 63, n).astype(np.uint64)
    sig = signatures(np.concatenate((element, element)), np.repeat([0, 1], n), np.concatenate((a, b)), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def written(spark, path, rows, labels):
    clashing = {n: F.lit(1) for n in ("extra", "_file", "_row", "uid", "kept", "_score", "block")}
    frame(spark, rows).select(*corpus_pipeline.COLUMNS).withColumns(clashing).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def last(d):
    return (d is None, d or 0)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage keeps exactly the rows that a plain version of it keeps of its own input."""
    rows = documents() + [(800 + i, f"$$ {i} !! 99 %% ## @@ {i} ~~ **") for i in range(30)]
    docs = written(spark, tmp_path, rows, [(d, int(d < 800), 0) for d, _ in rows if d is not None])
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = docs.collect()
        if name == "quality":
            model = rules.fit_quality(given, table(spark, str(tmp_path), "labels"))
            scores = rules.score_quality(given.drop("kept"), model).collect()
            left["accepted"] = [(r.doc_id, r.text or "") for r in scores if r.score >= rules.THRESHOLD]
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    said = lambda rows: sorted(((r.doc_id, r.text or "") for r in rows), key=repr)
    assert said(left["quality"]) == sorted(left["accepted"], key=repr) and 0 < len(left["quality"]) < len(rows)
    groups = defaultdict(list)
    for r in left["quality"]:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r)
    assert sorted((last(min((r.doc_id for r in g), key=last)), t) for t, g in groups.items()) == sorted((last(r.doc_id), re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in left["exact_dedup"])
    near = brute_near([(r.doc_id, r.text or "") for r in left["exact_dedup"]])
    assert said(left["near_dedup"]) == sorted((min(g, key=lambda x: last(x[0])) for g in near), key=repr)
    assert said(left["substring_dedup"]) == sorted(brute_removed([(r.doc_id, r.text or "") for r in left["near_dedup"]]), key=repr)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in left["substring_dedup"]:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in left["packing"]), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left["packing"])


def brute_near(rows):
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return list(groups.values())


def brute_removed(rows, window=50):
    first, out = {}, []
    split = [re.findall(r"[^\x20\x09-\x0D]+", x) for _, x in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (True, 1)), last(d))
    for (d, x), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < last(d):
                gone[i : i + window] = [True] * window
        if not any(gone):
            out.append((d, x))
        elif not all(gone):
            out.append((d, " ".join(y for y, g in zip(w, gone, strict=True) if not g)))
    return out


def test_pipeline_of_an_empty_table(spark, tmp_path):
    written(spark, tmp_path, [], [(1, 1, 0)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
