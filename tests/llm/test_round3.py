"""Merkle manifests, whitening and attention scores against plain loops, dense solves and numeric gradients."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from fieldloom.llm import attention_lm as lm
from fieldloom.llm import merkle, queries, whitening

from .test_operators import LONG, ODD, docs_of

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes, fan):
    """(root, siblings level by level of every leaf) by plain loops."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % fan
            paths[leaf].append([(hashes[j], j < i) for j in range(first, min(first + fan, len(hashes))) if j != i])
        hashes = [H(*hashes[i : i + fan]) for i in range(0, len(hashes), fan)]
        at = [i // fan for i in at]
    return hashes[0], paths


def manifest_brute(rows, fan):
    groups = defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        leaf = H(*[part(r[f]) for f in merkle.FIELDS])
        low = H(*[part(v if f != "text" or v is None else v.translate(lower)) for f, v in ((f, r[f]) for f in merkle.FIELDS)])
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, low))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[2] for x in sorted(groups[g])], fan) for g in names}
    root, tops = tree([subs[g][0] for g in names], fan)
    out = []
    for g, top in zip(names, tops):
        for (known, doc, leaf, low), path in zip(sorted(groups[g]), subs[g][1]):
            steps = path + top
            folded = low
            for level in steps:
                folded = H(*[h for h, before in level if before], folded, *[h for h, before in level if not before])
            out.append((doc if known else None, g, leaf, low, subs[g][0], root, H(*[h for level in steps for h, _ in level]), folded))
    return out


@pytest.mark.parametrize("fan", [16, 3, 2])
def test_merkle_manifest(spark, fan):
    rnd = random.Random(fan)
    rows = [(i, rnd.choice(["Some Text", "", None, f"T{i} ü"]), "en", rnd.choice(["hot", "hot", "hot", "b", None, "ä"]), i, 7, "k", 1.0, "x") for i in range(300)]
    rows += [(None, "Lost", None, None, None, 1, None, None, None), (500, "ALONE", "de", "solo", 5, 0, "", 0.0, "")] + [(5, "Same", "en", "b", 4, 1, "", 0.0, "")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, idx int, tree string, h double, _of string")
    led = merkle.manifest(df, fan)
    got = led.select("doc_id", "source", "leaf", "altered", "subroot", "root", merkle.proof_hash(led["path"]), merkle.fold(led["altered"], led["path"])).collect()
    assert Counter(map(tuple, got)) == Counter(manifest_brute([r.asDict() for r in df.collect()], fan))


def test_merkle_of_one_and_of_none(spark):
    one = merkle.manifest(docs_of(spark, ["A"])).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["path"] == []
    assert merkle.manifest(docs_of(spark, [])).count() == 0


def test_merkle_query(same_as_sql, spark, small):
    same_as_sql(queries.op11_merkle, queries.ORACLE_SQL["op11_merkle"])
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op11_merkle(spark, small).collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text[r["doc_id"]] or "")
        assert r["verified"] == (not changed)


# whitening


def vectors_of(spark, vectors, ids=None):
    rows = [(i, v, 1, 2.0, "x") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, _id int, component double, n string")


def test_pivoted_cholesky_and_jacobi():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (5, 5), (9, 4), (12, 0)):
        b = rng.standard_normal((d, rank)) * 10.0 ** rng.integers(-2, 3, rank)
        a = b @ b.T
        f = whitening.pivoted_cholesky(a)
        assert f.shape[1] == rank and np.allclose(f @ f.T, a, rtol=1e-10, atol=1e-12 * np.abs(a).max(initial=1))
        r = whitening.jacobi_columns(f)
        values = np.linalg.eigvalsh(a)[::-1][:rank]
        assert np.allclose((r * r).sum(0), values, rtol=1e-9) and np.allclose(r @ r.T, a, rtol=1e-9, atol=1e-12 * np.abs(a).max(initial=1))
    assert sorted((int(i), int(j)) for a, b in whitening.rounds(7) for i, j in zip(a, b)) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


def test_whitening_against_dense_solve(spark):
    rng = np.random.default_rng(2)
    good = (rng.standard_normal((400, 12)) * np.arange(1, 13) ** 1.5 + 50).astype(np.float32)
    good[7:10] = good[7]  # repeated rows count each
    odd = [None, [], [1.0] * 3, [float("nan")] * 12, [float("inf"), *[0.0] * 11], [None, *[1.0] * 11], [1e30] * 12]
    df = vectors_of(spark, good.tolist() + odd, [*range(399), None, *range(1000, 1000 + len(odd))])
    model = whitening.fit(df, 8)
    x = np.floor(1024 * good.astype(float)) + 100_000
    n, sums = len(x), x.sum(0)
    values, parts = np.linalg.eigh(np.cov(x.T, bias=True))
    values, parts = values[::-1][:8], parts[:, ::-1][:, :8]
    assert model.n == 400 and model.sums == [int(s) for s in sums]
    want = (x - sums / n) @ parts / np.sqrt(values)
    rows = whitening.whiten(df, model).repartition(7).orderBy("vec_id", "component").collect()
    got = np.array([r["whitened"] for r in rows]).reshape(400, 8)
    want = np.roll(want, 1, axis=0)  # the null id comes first
    assert np.allclose(got * np.sign((got * want).sum(0)), want, rtol=0, atol=1e-9)
    assert [int(r["deviation"]) for r in rows[::8]] == [sum(int(v) for v in (n * row - sums) ** 2) for row in np.roll(x, 1, axis=0)]
    assert np.allclose([r["explained"] for r in rows[:8]], values / np.trace(np.cov(x.T, bias=True)), rtol=1e-9)
    assert whitening.identity_error(df, model) < 1e-9


def test_whitening_of_few_vectors(spark):
    assert whitening.fit(vectors_of(spark, [None, []])) is None
    assert whitening.whiten(vectors_of(spark, []), None).count() == 0
    same = vectors_of(spark, [[1.0, 2.0]] * 5)  # no variance, no components
    assert whitening.whiten(same, whitening.fit(same)).count() == 0
    line = vectors_of(spark, [[float(i), 2.0 * i] for i in range(6)])
    model = whitening.fit(line, 8)
    assert len(model.values) == 1 and whitening.whiten(line, model).count() == 6 and whitening.identity_error(line, model) < 1e-9


def test_deviation_beyond_a_long():
    model = whitening.Whitening(10**9 + 7, 2, [3 * 10**13 + 1, -5], np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[99_999, 12], [-4, 10**6]])
    assert model.deviation(x) == [sum((model.n * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]


# attention scores


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in lm.initial(rng.integers(0, 9, lm.IDS)).items()}
    windows, counts = rng.integers(0, 200, (3, lm.CONTEXT + lm.SCORED)), np.array([24, 5, 1])
    _, grads = lm.gradients(w, windows, counts)
    for name, g in grads.items():
        for at in rng.permutation(np.flatnonzero(np.abs(g.ravel()) > 1e-4))[:4]:
            sides = []
            for step in (1e-5, -1e-5):
                v = {k: x.copy() for k, x in w.items()}
                v[name].ravel()[at] += step
                sides.append(-lm.gradients(v, windows, counts)[0])
            assert math.isclose((sides[0] - sides[1]) / 2e-5, g.ravel()[at], rel_tol=2e-2, abs_tol=2e-5), name


def test_gradients_do_not_depend_on_parts_or_on_what_the_arrays_held(monkeypatch):
    rng = np.random.default_rng(8)
    w, room = {k: v.astype(np.float64) for k, v in lm.initial(rng.integers(0, 9, lm.IDS)).items()}, lm.Room()
    for n in (9, 4, 1, 7):
        windows, counts = rng.integers(0, lm.IDS, (n, lm.CONTEXT + lm.SCORED)), rng.integers(0, lm.SCORED + 1, n)
        monkeypatch.setattr(lm, "PART", 64)
        mean, want = lm.gradients(w, windows, counts)
        monkeypatch.setattr(lm, "PART", 3)
        other, got = lm.gradients(w, windows, counts, room)
        assert math.isclose(mean, other, abs_tol=1e-12) and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-14) for k in lm.SHAPES)


def test_a_step_takes_little_fresh_memory():
    """Most of a step's time went into pages of new arrays (15 MB at once)."""
    rng = np.random.default_rng(6)
    steps, windows, counts = lm.Steps(lm.initial(rng.integers(0, 9, lm.IDS)), 1e-3), rng.integers(0, lm.IDS, (256, lm.CONTEXT + lm.SCORED)), np.full(256, lm.SCORED)
    steps.step(windows, counts)
    tracemalloc.start()
    held = tracemalloc.get_traced_memory()[0]
    steps.step(windows, counts)
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert peak < 5 << 20


def test_shards_send_few_rows(spark):
    """A shard's weights leave it as rows of many, and their mean is entry by entry."""
    rng = np.random.default_rng(2)
    shards = rng.standard_normal((3, 2 * lm.SENT + 5)).astype(np.float32)
    sent = [lm.in_rows(v) for v in shards]
    assert [x.num_rows for x in sent] == [3] * 3
    rows = spark.createDataFrame([tuple(r.values()) for x in sent for r in x.to_pylist()], "i int, w binary")
    assert np.allclose(lm.averaged(rows), shards.mean(0), atol=1e-6)
    assert len(lm.averaged(rows.limit(0))) == 0


def test_each_shard_is_a_task(spark, monkeypatch):
    """Shards were dealt by the hash of their number: some tasks had several, one after the other, and others none."""
    rnd, sent, real = random.Random(4), [], lm.averaged
    texts = docs_of(spark, [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(90)) for _ in range(200)]).selectExpr("text _text")
    windows = lm.training_windows(texts, PATH).localCheckpoint()
    have = windows.selectExpr("sum(length(places))").first()[0]
    monkeypatch.setattr(lm, "SHARD_WINDOWS", -(-have // 7))
    monkeypatch.setattr(lm, "averaged", lambda rows: sent.append(rows.where("i = 0").count()) or real(rows))
    lm.train(windows, rounds=1, least=1)
    assert sent == [7]


def plain_log_probability(w, before, ids):
    """log10 of ids one after the other: each attends to the ids of its window alone, one place at a time."""
    table, out = w["embed"] @ w["parts"], []
    for i, target in enumerate(ids):
        first = i - i % lm.SCORED  # of the scored part of its window
        line = [*before, *ids]
        seen = line[len(before) + first - lm.CONTEXT : len(before) + i]
        g = table[seen] + w["place"][: len(seen)]
        q, own = g[-1, : lm.WIDTH], g[-1, 3 * lm.WIDTH :]
        s = g[:, lm.WIDTH : 2 * lm.WIDTH] @ q / math.sqrt(lm.WIDTH)
        a = np.exp(s - s.max())
        z = np.maximum(np.concatenate((a / a.sum() @ g[:, 2 * lm.WIDTH : 3 * lm.WIDTH], own)) @ w["inner"] + w["inner_bias"], 0)
        for i, (which, at) in enumerate(((0, target // 256), (target // 256, target // 16 % 16), (target // 16, target % 16))):
            logits = z @ w[f"out{i}"][which] + w[f"bias{i}"][which]
            out.append(logits[at] - logits.max() - math.log(np.exp(logits - logits.max()).sum()))
    return sum(out) / math.log(10)


def test_windows_score_each_id_once_as_one_by_one():
    rng = np.random.default_rng(4)
    w = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in lm.initial(rng.integers(0, 9, lm.IDS)).items()}
    for n in (1, 23, 24, 25, 200):
        ids, before = rng.integers(0, lm.END, n), np.full(lm.CONTEXT, lm.END)
        windows, counts = lm.windows_of(np.zeros(0, np.int64), ids, lm.END)
        assert counts.sum() == n and np.concatenate([x[lm.CONTEXT : lm.CONTEXT + c] for x, c in zip(windows, counts)]).tolist() == ids.tolist()
        mine = lm.Scorer(w).log10(windows, counts).sum()
        assert math.isclose(mine, lm.gradients(w, windows, counts)[0] * n / math.log(10), rel_tol=1e-4)
        assert math.isclose(mine, plain_log_probability(w, before.tolist(), ids.tolist()), rel_tol=1e-4)


def base_brute(texts, training):
    c = Counter()
    for t in training:
        c.update((t or "").encode().lower().split())
        c[None] += 1
    total, out = sum(c.values()), []
    for t in texts:
        words = [*(t or "").encode().lower().split(), None]
        out.append((len(words), sum(c[w] > 0 for w in words), total, sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in words)))
    return out


@pytest.mark.parametrize("head", [0, 3, 1 << 19])
def test_scores_count_all_words(spark, head):
    rnd = random.Random(7)
    texts = [*ODD, *[" ".join(rnd.choice(["Apple", "apple", "pear", "plum", f"w{rnd.randint(0, 200)}"]) for _ in range(rnd.randint(0, 300))) for _ in range(60)], "same", "same"]
    docs = docs_of(spark, texts, [*range(len(texts) - 2), None, None])
    training = docs.where("doc_id % 10 != 0")
    got = lm.score(docs, training, PATH, keep=("perplexity", "doc_id"), head=head, rounds=1, least=40)
    assert got.columns == ["doc_id", "perplexity", "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "attention_score", "score", "count_weight"]
    rows = [tuple(r) for r in got.collect()]
    want = base_brute(texts, [r["text"] for r in training.collect()])
    near = lambda x: (*x[:3], round(x[3], 6))
    assert Counter(near(r[3:7]) for r in rows) == Counter(map(near, want))
    assert all(math.isfinite(r[7]) and math.isfinite(r[8]) and r[8] < 0 for r in rows)
    assert all(r[8] >= r[7] + r[3] * math.log10(1 - r[9]) - 1e-4 for r in rows)


def test_scores_do_not_depend_on_the_head_or_on_partitions(spark):
    texts = [LONG[:5000], "a b c", None, "a a a zz", "b c d e f"] * 4
    docs = docs_of(spark, texts)
    a = {r["doc_id"]: r["score"] for r in lm.score(docs, docs, PATH, head=0, rounds=1, least=10).collect()}
    b = {r["doc_id"]: r["score"] for r in lm.score(docs.repartition(3, "doc_id"), docs, PATH, rounds=1, least=10).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-3) for k in a)


def test_scores_without_training_or_texts(spark):
    docs = docs_of(spark, ["a b", None])
    rows = lm.score(docs, docs.where("false"), PATH, rounds=1, least=10).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows} == {(3, 0, 0), (1, 0, 0)} and all(abs(r["base_score"]) < 1e-9 for r in rows)
    assert lm.score(docs.where("false"), docs, PATH, rounds=1, least=10).count() == 0


def test_attention_learns(spark):
    """Held-out texts of a small grammar: what follows a word is nearly certain, which counts can't know."""
    rnd = random.Random(5)
    nxt = {a: b for a, b in zip("red green blue black white grey".split(), "green blue black white grey red".split())}

    def text(n):
        w, out = rnd.choice(list(nxt)), []
        for _ in range(n):
            out.append(w)
            w = nxt[w] if rnd.random() < 0.97 else rnd.choice(list(nxt))
        return " ".join(out)

    docs = docs_of(spark, [text(60) for _ in range(200)])
    rows = lm.score(docs.where("doc_id < 20"), docs.where("doc_id >= 20"), PATH, rounds=3, least=6000).collect()
    assert sum(r["attention_score"] for r in rows) > 0.6 * sum(r["base_score"] for r in rows)


def test_score_query(spark, small):
    rows = queries.op13_lm_score(spark, small).collect()
    assert rows and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)  # so few held-out texts tell little


# html: what decides within and without an article


def html_of(spark, pages):
    from fieldloom.llm import html_extract

    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract_text(df).collect()}


def test_names_within_an_article_delete_nothing(spark):
    page = "<body><nav>n</nav><article><h2 id='related-work'>Related work</h2><h2 id='alert-levels'>Alerts</h2><p id='social'>Social</p><section class='notice'><p>Own {i}</p></section><div class='ad'>Text {i}</div></article><div class='ad'>x</div></body>"
    few = html_of(spark, [page.format(i=i) for i in range(3)])
    assert few[1] == "Related work\n\nAlerts\n\nSocial\n\nOwn 1\n\nText 1"


def test_recurring_containers_are_template_with_or_without_an_article(spark):
    """Within and without an article: a notice of changing words and a list of links go by their shape, a constant box by its text; paragraphs of the article stay."""
    inner = "<h2 id='related-work'>Title {i}</h2><p>Licence line</p><div class='notice'><p>Read {i} more</p></div><ul><li><a href='{i}'>Link {i}</a></li></ul><div class='q7'><p>Box</p></div><div class='body'><p>Own {i}</p></div>"
    for page, licence in (("<body><article>" + inner + "</article></body>", "Licence line\n\n"), ("<body>" + inner + "</body>", "")):
        got = html_of(spark, [page.format(i=i) for i in range(12)])
        assert got == {i: f"Title {i}\n\n{licence}Own {i}" for i in range(12)}


def test_templates_are_the_counts_of_plain_loops(spark, small):
    from fieldloom.llm import html_extract

    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()
    for strip in (False, True):
        rows = [(r.page_id, r.url, r.html.replace("<article", "<div").replace("</article", "</div") if strip and r.html else r.html) for r in pages]
        hosts, seen, hashes = Counter(), defaultdict(Counter), []
        for _, url, html in rows:
            host = (url or "").split("://")[-1].split("/")[0].lower()
            tree = html_extract.parse(html or "")
            own = {h - (1 << 64) if h >> 63 else h for hs in html_extract.subtree_hashes(tree, html_extract.roots(tree)).values() for h in hs}
            hosts[host] += 1
            seen[host].update(own)
            hashes.append((host, own))
        want = Counter()
        for (page, _, html), (host, own) in zip(rows, hashes):
            want[page, html_extract.main_text(html, frozenset(h for h in own if seen[host][h] >= 5 and seen[host][h] >= 0.2 * hosts[host]))] += 1
        got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert Counter((r.page_id, r.text) for r in got) == want


def test_all_training_text_is_learnt_from(spark):
    """Every stretch trains attention or fits the weight of the counts, however few windows are asked for."""
    rnd = random.Random(9)
    docs = docs_of(spark, [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(3000)) for _ in range(40)])
    texts = docs.selectExpr("text _text")
    given, real = [], lm.train

    def spy(windows, rounds, least):
        given.append(windows.agg({"n": "sum"}).first()[0])
        return real(windows, rounds, least)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "train", spy)
        lm.score(docs, docs, PATH, rounds=1, least=10)
    seen = lm.Words(PATH)
    rest, every = (sum(len(ids) for r in texts.collect() for _, ids, _, _ in lm.stretches(r["_text"], seen, low, 1.0, lm.END)) for low in (lm.TRAINED, 0.0))
    assert given == [every - rest] and given[0] > 0.9 * every


def test_grams_leave_a_worker_in_parts(spark):
    """A text of very many different n-grams: no batch is larger than SENT rows, and the sums are those of a plain count."""
    from fieldloom.llm import lm_quality

    given = []

    class Rows:
        select = groupBy = agg = lambda self, *_: self

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_quality, "map_rows", lambda df, fn, schema: given.append(fn) or df)
        lm_quality.count_grams(Rows())
    rnd = random.Random(4)
    texts = ["".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(90_000)), "abab", None, "abc" * 1000]
    langs, got, largest = ["zh", "en", "en", None], Counter(), 0
    for names, g, n in given[0](iter([[langs, texts], [langs, texts]])):
        largest = max(largest, len(names))
        got.update({(a, int(b)): int(c) for a, b, c in zip(names, g, n, strict=True)} if len(set(zip(names, map(int, g)))) == len(names) else {})
    want = Counter()
    for lang, text in zip(langs, texts):
        for x in lm_quality.grams(text).tolist() if text else []:
            want.update({(lang, x): 2, (lm_quality.ALL, x): 2} if lang else {(lm_quality.ALL, x): 2})
    assert got == want and largest <= 1 << 15


def test_words_are_spelt_many_at_once_as_one_by_one(monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", 28)  # seven words a call
    words = lm.words_of(" ".join([*filter(None, ODD), "x" * 200, "é" * 70, " a b   ÄB", LONG[:3000]]))
    ids, sizes = lm.spell(PATH, words)
    alone = [np.concatenate([lm.speller(PATH)[0].encode_ordinary(s[at : at + 64]) for at in range(0, len(s), 64)]) for s in (" " + w.decode() for w in words)]
    assert sizes.tolist() == [len(x) for x in alone] and ids.tolist() == np.concatenate(alone).tolist()
    seen = lm.Words(PATH)
    for at in range(0, len(words), 50):
        part = words[at : at + 50]
        number = seen.numbers(part)
        assert np.array_equal(seen.spelt(number)[0], lm.spell(PATH, part)[0]) and seen.key[number].tolist() == [lm.word_key(w) for w in part]


def test_training_rows_hold_the_windows_of_whole_runs(spark):
    """A text's trained stretches come as rows of up to 64 windows, not as a row a window, with the ids that stretches have one by one."""
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(n)) for n in (0, 1, 63, 64, 65, 500, 6400)] + [None]
    for share in (0.5, lm.TRAINED, 1.0):
        rows = lm.training_windows(docs_of(spark, texts).coalesce(1).selectExpr("text _text"), PATH, share).collect()
        got = []
        for r in rows:
            w, n = np.frombuffer(r["ids"], "<u2").reshape(-1, lm.CONTEXT + lm.SCORED), list(r["places"])
            assert len(w) == len(n) <= 64 and sum(n) == r["n"]
            got += [i for line, k in zip(w, n) for i in line[lm.CONTEXT : lm.CONTEXT + k].tolist()]
        seen = lm.Words(PATH)
        assert got == [i for t in texts for _, ids, _, _ in lm.stretches(t, seen, 0, share, lm.END) for i in ids.tolist()]
        assert share < 1 or len(rows) <= len(texts) + len(got) // (64 * lm.SCORED)
