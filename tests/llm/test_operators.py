"""Operators for training-data pipelines against brute force, on small tables with every odd case."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

from fieldloom.llm import ann, bpe, chat, html_extract, lm_quality, packing, quality_rules, queries, simhash, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, _id int, _key string, perplexity double, kept string"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 7, "k", 1.0, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOC)


LONG = " ".join(f"word{i % 977}x{i}" for i in range(12_000))
ODD = [None, "", " \n\t ", "one", "one two", LONG, LONG, "a b c a b c a b c", "Ünï cödé ± 漢字 😀 don't 12345", "x" * 3000, "|" * 500]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [*ODD, "same", "same"], [*range(len(ODD) - 1), None, 50, 50])


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, [])


# quality rules


def rules_brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(wins)
    rep = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_rule_measures(spark, odd, nothing):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("a b c d e\n f\n g".split(" ")) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    for df in (odd, docs_of(spark, texts)):
        got = quality_rules.ledger(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(map(tuple, got)) == Counter(rules_brute(r.text) for r in df.collect())
    assert quality_rules.ledger(nothing).count() == 0


def test_rule_policies_and_ablation(spark, odd):
    led = quality_rules.ledger(odd).cache()
    bits = [r.fail_bits for r in led.collect()]
    for version in quality_rules.POLICIES:
        mask = quality_rules.mask_of(quality_rules.POLICIES[version])
        assert quality_rules.apply_policy(led, version).where("kept").count() == sum(not b & mask for b in bits)
        got = {r.rule: (r.n_failed, r.n_only_this) for r in quality_rules.ablations(led, version).collect()}
        for rule in quality_rules.POLICIES[version]:
            bit = quality_rules.mask_of([rule])
            want = sum(bool(b & bit) for b in bits), sum((b & mask) == bit for b in bits)
            assert got.get(rule, (0, 0)) == want
    assert quality_rules.passing(odd).columns == odd.columns


def test_rule_of_a_bare_host(spark):
    pages = spark.createDataFrame([(1, "http://network/a"), (2, "http://a.net/"), (3, "http://net/b")], "page_id long, url string")
    rules = [("net", "", "block"), ("a.net", None, "allow")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {1: (None, "allow"), 2: ("a.net/", "allow"), 3: ("net/", "block")}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


# urls


def url_brute(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    host = "".join(c.lower() if c < "\x7f" else c for c in host)
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_url_rules(spark):
    rnd = random.Random(2)
    labels = ["a", "b", "net", "org", "example", "B"]
    urls = [f"http://{'.'.join(rnd.choice(labels) for _ in range(rnd.randint(1, 5)))}{rnd.choice(['', '/', '/en/', '/en/x?q=/de/', '/de', '#/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "x://", "http:///en/", "http://ex.net:80/en/", urls[0], urls[0]]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.net", "/en/", "block"), ("a.b.net", "/e", "allow"), ("org", "/de", "block"), ("b", "/", "block"), ("b", "/", "allow"), ("example", "/en/x", "block")]
    pages = spark.createDataFrame([(i % 250, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, _salt int")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), salts=3)
    merged = [r for r in rules if r != ("b", "/", "allow")]
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter((i % 250, *url_brute(u, merged)) for i, u in enumerate(urls))
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)


# simhash


def group_brute(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def fp_brute(text):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def test_simhash_components(spark, odd, nothing):
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(150)]
    texts = [*ODD]
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "edit"
        texts.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    fps = [fp_brute(t) for t in texts]
    want = group_brute(fps, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs_of(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}
    assert simhash.simhash_components(odd).count() == odd.count()
    assert simhash.simhash_components(nothing).count() == 0


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    hashes = simhash.shingle_hashes("A b  c é", 3)
    want = [r[0] & (2**64 - 1) for r in spark.createDataFrame([("a b c",), ("b c é",)], "s string").select(F.xxhash64("s")).collect()]
    assert hashes.tolist() == want


def near_brute(texts):
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] and not sets[j] and (texts[i] or "") != (texts[j] or ""):
                continue
            both = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and sets[j] and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_near_duplicates(spark, nothing):
    rnd = random.Random(4)
    texts = ["alone here with some words of its own", "another text that stands alone as well", None, ""]
    for g in range(8):
        base = [f"g{g}w{rnd.randint(0, 5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for k in range(6):
            w = list(base)
            w[20 * k + 5] = "edit"
            texts.append(" ".join(w))
    texts += texts[:6]
    df = docs_of(spark, texts)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(near_brute(texts))
    assert simhash.drop_near_duplicates(nothing).count() == 0
    again = docs_of(spark, ["p q", "p q", "p q"], [None, 9, 9])
    assert [r.doc_id for r in simhash.drop_near_duplicates(again).collect()] == [9]


@pytest.mark.parametrize(("few", "large"), [(0, 0), (1000, 0), (1000, 3), (4, 1000)])
def test_near_duplicates_beyond_the_pivots(spark, monkeypatch, few, large):
    """Pivots that miss lose no pair: here ball hashing yields none at all, with many or few rounds of stars."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "_candidates", lambda reps: reps.selectExpr("no x", "no y", "0 bits").where("false"))
    rnd = random.Random(6)
    texts = []
    for g in range(6):
        chain = [f"c{g}w{i}" for i in range(120)]
        for k in range(12):  # each is near the next ones only
            texts.append(" ".join(chain))
            chain = chain[6:] + [f"c{g}n{k}x{i}" for i in range(6)]
    rnd.shuffle(texts)
    out = simhash.drop_near_duplicates(docs_of(spark, texts))
    assert sorted(r.doc_id for r in out.collect()) == sorted(near_brute(texts))
    assert out.count() == 6


def test_near_duplicates_of_block_edits(spark):
    """One passage replaced, at a similarity of 0.80 to 0.85."""
    rnd = random.Random(8)
    texts = []
    for g in range(40):
        base = [f"b{g}w{rnd.randint(0, 5000)}" for _ in range(200)]
        at = rnd.randint(0, 180)
        texts += [" ".join(base), " ".join(base[:at] + [f"b{g}new{i}" for i in range(14)] + base[at + 14 :])]
    sims = [simhash.jaccard(*[np.unique(simhash.shingle_hashes(t, 5)).tobytes() for t in texts[i : i + 2]]) for i in range(0, 80, 2)]
    assert 0.8 <= min(sims) <= 0.85
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect()) == list(range(0, 80, 2))


# toxicity of long texts


def test_long_clean_text_is_not_toxic(spark):
    """The sample holds long texts and is weighted to the label share, so length alone is no offence."""
    rnd = random.Random(9)
    clean = lambda n: " ".join(" ".join(f"w{rnd.randint(0, 300)}" for _ in range(10)) + "." for _ in range(n))
    texts = [clean(12) for _ in range(320)] + [clean(1200) for _ in range(20)] + [clean(6) + " you vile grubling go." + clean(6) for _ in range(36)] + [clean(12) for _ in range(4)]
    labels = spark.createDataFrame([(i, int(i >= 340)) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts), labels, max_toxic=40, max_other=80)
    scorer = toxicity.Scorer(model)
    assert scorer.score(clean(2000))[0] < 0.5
    assert scorer.score(clean(5) + " you vile grubling go.")[0] > 0.5


# packing


@lru_cache
def word_tokenizer(path):
    """The library's own object, as its README has it: strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def test_packing(spark, odd, nothing, small):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = word_tokenizer(path)
    for df in (odd, docs_of(spark, [" ".join(["alpha beta"] * n) for n in (10, 3000, 5000, 700, 1, 2100)] * 40)):
        want = Counter()
        for r in df.collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
            want[r.doc_id, np.array(ids, "<u4").tobytes()] += 1
        rows = packing.pack(df, path, open_windows=4).collect()
        seqs, pieces = defaultdict(list), defaultdict(list)
        for r in rows:
            assert len(r.ids) == 4 * r.length and r.length > 0
            seqs[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        used = 0
        for s in seqs.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= 4096
            used += at
        assert len(seqs) * 4096 - used <= 0.02 * len(seqs) * 4096 + 4 * 4096
        assert sum(len(b) for ps in pieces.values() for _, b in ps) == sum(len(b) * n for (_, b), n in want.items())
        for (doc, b), n in want.items():
            if n == 1 and sum(k[0] == doc for k in want) == 1:
                assert b"".join(x for _, x in sorted(pieces[doc, len(b) // 4])) == b
    assert packing.pack(nothing, path).count() == 0


def test_word_tokenizer_is_exact(duck):
    t = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r[0] for r in duck.execute("SELECT text FROM documents LIMIT 150").fetchall()]
    texts += ["a <|endoftext|> b", "don't Σας ΣΑΣ É é \x85z\x1cq İ \xa0 x", "\x00 ǅ ŉ 'S ½ ²3 12345", "".join(chr(i) + " a"[i % 2] for i in range(1, 0x500))]
    for x in texts:
        assert t.encode(x) == np.array(word_tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode(x, add_special_tokens=False).ids, "<u4").tobytes()


# byte-level BPE


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_encode_and_decode(spark, odd, nothing, tik):
    path, enc = tik
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab  \n\t 'sé1２漢😀\x85\xa0 \x1c.,!_Z") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    for df in (odd, docs_of(spark, texts), nothing):
        out = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path).collect()
        want = Counter((r.doc_id, tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in df.collect())
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in out) == want


def test_bpe_fold_by_higher_order_functions(spark, tik):
    from pyspark.sql import functions as F

    path, enc = tik
    words = [" the", "a", "Zusammenhänge", " 漢字", "x" * 40, "!!", " 12", "schßeitü"]
    df = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, b array<int>")
    got = {r.w: list(r.ids) for r in df.select("w", bpe.fold_merges(F.col("b"), bpe.RankMap(bpe.read_ranks(path))).alias("ids")).collect()}
    assert got == {w: enc.encode_ordinary(w) for w in words}


# html


def test_html_text_matches_documents(spark, small, duck):
    texts = {" ".join(t.split()) for (t,) in duck.execute("SELECT text FROM documents").fetchall()}
    for r in queries.op9_html_text(spark, small).collect():
        assert " ".join(r.text.split("\n\n", 1)[-1].split()) in texts
        assert r.n_chars == len(r.text)


def test_html_template_removal(spark, small):
    page = "<body><div class='x9'><p>Site line {s}</p><span>menu</span></div><article><h1>T{i} &amp; &lt;b&gt;</h1><p>Same passage</p><div class='q3'><p>Get our letter</p></div><p>body  {i}\n text<p>open</article><div id=comment-list><p>hi</p></div>"
    bare = "<div class='x9'><ul><li>Home<li>About</ul></div><p>own text {i}</p><script>var a='</p>';</script><!-- c --><form><p>q</p></form>"
    rows = [(i, "http://a.net/x", page.format(i=i, s="x")) for i in range(20)] + [(100 + i, "http://b.net/", bare.format(i=i)) for i in range(20)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", "plain words"), (203, "u", "<p>" * 3000 + "deep"), (203, "u", "<p>" * 3000 + "deep"), (204, "u", "<article><p>a<br>b</p></article" + "x" * 10)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, _key string")
    got = defaultdict(list)
    for r in html_extract.extract_text(df).collect():
        got[r.page_id].append(r.text)
    assert sum(map(len, got.values())) == len(rows)
    for i in range(20):
        assert got[i] == [f"T{i} & <b>\n\nSame passage\n\nbody {i} text\n\nopen"]
        assert got[100 + i] == [f"own text {i}"]
    assert got[200] == [""] and got[201] == [""] and got[202] == ["plain words"] and got[203] == ["deep", "deep"] and got[204][0].startswith("a b")
    assert html_extract.extract_text(df.limit(0)).count() == 0


# nearest neighbours


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[200:700] = x[200]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [float("inf")] + [1.0] * 23), (3004, [None] + [1.0] * 23), (3005, [1.0, 2.0]), (None, [1.0] * 24), (3006, [])]
    df = spark.createDataFrame([(a, b, "s", 1.0) for a, b in rows + bad], "vec_id long, embedding array<float>, rank string, score double")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), block_rows=400, query_rows=40)
    by = defaultdict(list)
    for r in got.collect():
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    d = x.astype(np.float64)
    hits = 0
    assert sorted(by) == list(range(0, 1500, 20))
    for q, rs in by.items():
        s = (d * d[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:20]
        rs.sort()
        assert [r[0] for r in rs] == list(range(1, 21))
        assert [r[1:] for r in rs] == [(i, pytest.approx(s[i], abs=1e-9)) for i in (r[1] for r in rs)]
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(rs, rs[1:]))
        hits += len({r[1] for r in rs} & set(want.tolist()))
    assert hits / (20 * len(by)) >= 0.95
    few = ann.nearest(df.where("vec_id < 5"), k=20).collect()
    assert Counter(r.query_id for r in few) == {i: 4 for i in range(5)}
    assert ann.nearest(df.limit(0)).count() == 0


# toxicity


def test_toxicity_learns_sentences(spark, nothing):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts, ys = [], []
    for i in range(400):
        sents = [" ".join(rnd.choice(words) for _ in range(8)) for _ in range(rnd.randint(1, 12))]
        ys.append(i % 3 == 0)
        if ys[-1]:
            at = rnd.randrange(len(sents))
            sents[at] += rnd.choice([" vilefoo", " vilebar"])
        texts.append(". ".join(sents))
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(ys) if i % 5] + [(None, 1), (3, None)], "doc_id long, toxic int")
    df = docs_of(spark, [*texts, None, "", "fine words", "so VILEFOO!"])
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert sum((got[i].score >= 0.5) == ys[i] for i in held) / len(held) > 0.95
    assert got[400].score == got[401].score == 0.0 and got[402].score < 0.5 < got[403].score
    for i in held:
        for s in got[i].spans:
            assert "vile" in texts[i][s.start : s.end]
    assert toxicity.fit(nothing, labels) == {"": -4.0}
    assert toxicity.score(nothing, model).count() == 0


# chats


def test_chat_roles(spark):
    rnd = random.Random(7)
    rows = []
    for c in range(60):
        turn = 0
        if c % 3 == 0:
            rows.append((c, turn, "system", "System: be brief"))
            turn += 1
        for _ in range(rnd.randint(1, 5)):
            rows.append((c, turn, "user", rnd.choice(["User: ", ""]) + "what is it " + "x " * rnd.randint(0, 5) + "?"))
            rows.append((c, turn + 1, "assistant", rnd.choice(["Assistant: ", ""]) + "It is this.\n" * rnd.randint(3, 9)))
            turn += 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, _chunk int")
    model = chat.fit(df)
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(df.drop("role"), model).collect()}
    assert sum(got[c, t].role == role for c, t, role, _ in rows) / len(rows) > 0.95
    small = {(r.conv_id, r.turn): r.role for r in chat.format_chats(df, model, chunk=2).collect()}
    assert small == {k: r.role for k, r in got.items()}  # chunks change nothing
    assert all(not r.text.startswith(("User:", "Assistant:", "System:")) for r in got.values())
    odd = spark.createDataFrame([(1, 0, None), (1, 0, None), (None, 1, "x"), (2, None, "y"), (3, -5, "z" * 100_000)], "conv_id long, turn long, text string")
    assert Counter(r.conv_id for r in chat.format_chats(odd, model).collect()) == {1: 2, 3: 1}
    assert chat.format_chats(odd.limit(0), model).count() == 0
    assert chat.fit(df.limit(0))["roles"] == ["assistant", "user"]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(8)
    k = 3
    start, stp, emit = np.log(rng.dirichlet(np.ones(k))), np.log(rng.dirichlet(np.ones(k), k)), np.log(rng.dirichlet(np.ones(5), k))
    from itertools import product

    for _ in range(20):
        syms = rng.integers(0, 5, 6)
        score = lambda p: start[p[0]] + sum(emit[a, s] for a, s in zip(p, syms)) + sum(stp[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(score(p) for p in product(range(k), repeat=6))
        assert score(chat.viterbi(syms, start, stp, emit)) == pytest.approx(best)


# language model


def windows(t):
    s = "\0" * (lm_quality.ORDER - 1) + t
    return [s[i : i + lm_quality.ORDER] for i in range(len(t))]


def kn_brute(texts):
    """Interpolated modified Kneser-Ney over characters, straight from the definition."""
    order = lm_quality.ORDER
    counts = {order: Counter(g for t in texts for g in windows(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def disc(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        usual = {1: 0.5, 2: 0.75, 3: 1.0}
        own = {k: k - (k + 1) * y * n[k + 1] / n[k] if n[1] and n[k] else 0 for k in (1, 2, 3)}
        return {k: min(float(k), own[k]) if own[k] > 0 else usual[k] for k in (1, 2, 3)}

    d = {k: disc(c) for k, c in counts.items()}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 65536
        rows = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(rows.values())
        if not total:
            return p(gram[1:])
        n = rows.get(gram, 0)
        rest = sum(d[k][min(n, 3)] for n in rows.values()) / total
        return (n - d[k][min(n, 3)] if n else 0) / total + rest * p(gram[1:])

    return p


def test_kneser_ney(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "mat cat hat", "漢字 and 漢字"]
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    model = lm_quality.train(docs_of(spark, [*texts, None, "not trusted"]), labels)
    p = kn_brute(texts)
    rng = random.Random(9)
    asked = {"".join(rng.choice("thecatsonmdg 漢z") for _ in range(lm_quality.ORDER)) for _ in range(150)} | {g for t in texts for g in windows(t)}
    code = lambda g: int(lm_quality.grams(g)[-1])
    rows = [(lang, code(g), 1) for g in asked for lang in ("en", "*")]
    got = {(r.lang, r.g): r.loss for r in lm_quality.losses(spark.createDataFrame(rows, "lang string, g long, n long"), model).collect()}
    for g in asked:
        assert np.exp(-got["en", code(g)]) == pytest.approx(p(g), rel=1e-9) == pytest.approx(np.exp(-got["*", code(g)]), rel=1e-9)


@pytest.mark.parametrize("head", [0, 40, 1 << 18])
def test_perplexity_with_and_without_head(spark, monkeypatch, head):
    """What is in the head changes nothing: losses of all other n-grams come by join."""
    monkeypatch.setattr(lm_quality, "HEAD", head)
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "ümlaut", "漢字"]) for _ in range(20)) for _ in range(12)]
    df = docs_of(spark, [*texts, "quite other words 😀", "", None, texts[0]])
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    model = lm_quality.train(df, labels)
    p = kn_brute(texts[:8])
    usual = np.mean([-np.log(p(g)) for t in texts[:8] for g in windows(t)])
    for r in lm_quality.perplexity(df, model).collect():
        t = ([*texts, "quite other words \ud83d\ude00", "", "", texts[0]])[r.doc_id]
        want = np.exp((sum(-np.log(p(g)) for g in windows(t)) + 100 * usual) / (len(t) + 100)) if t else None
        assert r.perplexity == (pytest.approx(want, rel=1e-9) if t else None)


def test_quality_classifier(spark, odd, nothing):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7)))
    good = [" ".join(word() for _ in range(80)) for _ in range(60)]
    bad = ["%%% ".join(word().upper() for _ in range(80)) for _ in range(10)]
    df = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(65, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = lm_quality.accepted(df, labels)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert lm_quality.classify(odd, labels.limit(0)).where("kept").count() == odd.count()
    assert lm_quality.accepted(nothing, labels).count() == 0
    judged = {r.doc_id: r for r in lm_quality.classify(odd, labels.withColumn("doc_id", labels.doc_id * 0 + 5)).collect()}
    assert judged[0].perplexity is None and not judged[0].kept


# the contracts' digests


def test_contract_columns(spark, small, duck, tik):
    import hashlib

    want = {i: t for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    for r in queries.op4_byte_bpe(spark, small).collect():
        ids = tik[1].encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want[r.doc_id].encode()).hexdigest())
    tok = word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.op1_packing(spark, small).collect():
        ids = [*tok.encode(want[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    fps = {r.doc_id: int(r.fingerprint, 16) for r in queries.op8_simhash_dedup(spark, small).collect()}
    assert fps == {i: fp_brute(t) for i, t in want.items()}
    held = {r.doc_id: r.held_out for r in queries.op3_toxicity(spark, small).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in want}


def test_pipeline(spark, small, duck):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    from fieldloom.llm.common import materialize

    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = materialize(stage(spark, docs, small), name)
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= before
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {i for (i,) in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    assert len(good & rows.keys()) > 0.6 * len(good)
    tok = word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in rows.values())
    assert sum(r.length for r in pipeline.run(spark, small).collect()) == total


# very long and hostile input


@pytest.mark.parametrize("page", ['<a "' * 100_000, "<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<div></div>" * 20_000, '<a ="' * 50_000 + ">", "<!" * 100_000, "<p><div>" + "<b>" * 20_000 + "<h1></h1>" * 20_000, "<p>" * 20_000])
def test_html_takes_linear_time(page):
    import time

    began = time.process_time()
    html_extract.main_text(page)
    html_extract.page_hashes(page)
    assert time.process_time() - began < 20


def test_html_quotes():
    assert html_extract.main_text("<article><p title=\"a > b\">one</p><p title='x' id=don't>two</p><a href=\"u>three</a>") == "one\n\ntwo\n\nthree"
    assert html_extract.main_text("1 < 2 and <article><p>3 < 4</p>") == "3 < 4"


def test_toxicity_score_is_a_noisy_or(spark):
    import re

    model = {"": -3.0, "=bad": 2.0, "bad": 0.7, "ugl": 1.5, "=fine": -0.5}
    texts = ["Bad bad ugly. fine fine", "ugliest!\nbadge? 12bad34", "nothing here. at all", "bad" + "1" * 200_000 + "x. ok"]

    def weight(token):
        word = re.sub(r"^[\W\d_]+", "", token.lower())
        word = word[::-1]
        word = re.sub(r"^[\W\d_]+", "", word)[::-1]
        return sum(model.get(f, 0) for f in ["=" + word, *(word[:n] for n in range(3, 9) if n <= len(word))]) if word else 0

    for r in toxicity.score(docs_of(spark, texts), model).collect():
        miss = 1.0
        for s in re.split(r"[.!?\n]", texts[r.doc_id]):
            if s.split():
                miss *= 1 - 1 / (1 + np.exp(-(model[""] + sum(weight(t) for t in set(s.split())))))
        assert r.score == pytest.approx(1 - miss, rel=1e-9)


def test_toxicity_of_long_tokens_and_clashing_labels(spark):
    import time

    began = time.process_time()
    assert toxicity.word_features("7a" + "1" * 300_000 + "b9")[0] == "=a" + "1" * 300_000 + "b"
    assert toxicity.word_features("1" * 300_000) == []
    assert time.process_time() - began < 5
    texts = ["so vile indeed"] * 30 + ["all is well here"] * 60
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)] + [(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.score(docs_of(spark, texts), toxicity.fit(docs_of(spark, texts), labels)).where("doc_id < 30 AND score < 0.5").count() == 0


def test_chat_with_one_hot_turn(spark):
    """Many lines of one turn number make several chunks and the result of one long pass."""
    rnd = random.Random(12)
    rows = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["User: ", "Bot: ", ""]) + rnd.choice(["why is it so?", "because it is.", "x" * 90])) for t in (0, 1, 2) for _ in range(40 if t == 1 else 3)]
    rows += [(2, 5, "user", "alone?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(df)
    seen = chat._lines(df, "conv_id", "turn", "text").where("_conv = 1").select("_turn", "_sym", "_text").collect()
    seen = sorted(map(tuple, seen))
    path = chat.viterbi(np.array([s for _, s, _ in seen]), model["start"], model["step"], model["emit"])
    want = Counter((t, x) for (t, _, _), x in zip(seen, (model["roles"][i] for i in path)))
    for chunk in (4, 7, 1024):
        got = chat.format_chats(df, model, chunk=chunk).collect()
        assert Counter((r.turn, r.role) for r in got if r.conv_id == 1) == want and len(got) == len(rows)


def test_near_duplicates_tie(spark):
    """Of rows that repeat id and text the one whose columns come first as JSON stays."""
    rows = [(7, "a b c", s) for s in ("z", "b", "y")] + [(8, "a b c", "a"), (9, "d e f g", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, simhash.drop_near_duplicates(df).collect())) == [(7, "a b c", "b"), (9, "d e f g", "q")]


def test_nearest_recall_over_blocks(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    for rows in (60, 8192):
        got = defaultdict(set)
        for r in ann.nearest(df, df.where("vec_id % 20 = 0"), block_rows=rows, query_rows=10).collect():
            got[r.query_id].add(r.vec_id)
        hits = 0
        for q in got:
            s = (m * x[q]).sum(1)
            s[ids == q] = -np.inf
            hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        assert len(got) == len(ids[ids % 20 == 0]) and hits / (20 * len(got)) >= 0.95


def test_only_crowded_shingles_take_part_in_stars(spark, monkeypatch):
    """Twenty near copies that the first pass left apart are joined; pairs of texts that share a third stay out of the round."""
    rnd, real, seen = random.Random(11), simhash._verified, {}
    words = lambda n: [f"w{rnd.randint(0, 10**9)}" for _ in range(n)]
    base, texts = words(100), []
    for i in range(20):
        texts.append(" ".join([*base[: 4 * i + 10], *words(1), *base[4 * i + 11 :]]))
    for _ in range(15):
        same = words(30)
        texts += [" ".join([*same, *words(30)]) for _ in range(2)]

    def spy(pairs, keyed, reps, name):
        seen[name] = pairs.count()
        return real(pairs.where("false") if name == "1" else pairs, keyed, reps, name)

    monkeypatch.setattr(simhash, "_verified", spy)
    assert simhash.drop_near_duplicates(docs_of(spark, texts)).count() == 31
    assert 0 < seen["-star2"] <= 20


def test_word_hashes_keep_nothing():
    import tracemalloc

    simhash.word_hashes("a b")
    tracemalloc.start()
    for i in range(20):
        simhash.word_hashes(" ".join(f"{i}x{j}" for j in range(10_000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20
