"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests_llm_brute import components_of, shingle_set, words

from tessella.llm import additive, bpe, chat, langid, mixing, paritysketch, quality, tokencount, urls, wavelet

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
TEXTS = [
    None, "", "   \n\t ", "a", "one two three four", "Hello World, it's 12 o'clock\n\n  twice", "x<|endoftext|>y  <|startoftext|>", "été ÀÇÉ ñandú ΑΣ İstanbul e\u0301", "中文 字符 😀 😀",
    " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(195)) + " a b c d e", "spam " * 80, "# $ % & | < >", LONG,
]
ROWS = [(i, t, ["en", None, "de"][i % 3], [None, "s0", "s1"][i % 3]) for i, t in enumerate(TEXTS)] + [(None, "null id here with words", "en", "s0"), (9, TEXTS[9], "en", "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns beside the four have names that operators use for their own."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.lit(7) for n in ("n", "node", "size", "ids", "host", "row", "score", "target", "component_id", "_id", "kept")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return out


def encoded(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, none):
    out = tokencount.count_tokens(docs, BYTE)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((i, len((t or "").encode()), len(encoded(BYTE, t)), len(encoded(BYTE, t)) > 512) for i, t, _, _ in ROWS), key=repr)
    assert rows(out) == want
    assert tokencount.count_tokens(none, BYTE).count() == 0


def test_bpe_round_trip(docs, none):
    out = bpe.encode(docs, BYTE, lexicon_words=50, decoded_col="back")
    want = sorted(((i, encoded(BYTE, t), t or "") for i, t, _, _ in ROWS), key=repr)
    assert rows(out.select("doc_id", "ids", "back")) == want
    assert rows(bpe.decode(out.select("doc_id", "ids"), BYTE)) == want
    odd = docs.sparkSession.createDataFrame([(1, None), (2, []), (3, [999_999, -1, 72])], "doc_id long, ids array<int>")
    assert rows(bpe.decode(odd, BYTE).select("doc_id", "decoded")) == [(1, None), (2, ""), (3, bpe.decoded(np.array([72]), [1], *bpe.token_bytes(BYTE))[0])]
    assert bpe.encode(none, BYTE).count() == 0


def test_token_files(docs, none, tmp_path):
    import zlib

    files = wavelet.write_tokens(docs, str(tmp_path / "files"), WORD, file_tokens=300)
    assert files.count() > 3
    got = [tuple(r) for r in wavelet.read_documents(files).orderBy("start").collect()]
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, text, _, _ in ordered:
        ids = encoded(WORD, text) + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert wavelet.read_documents(wavelet.write_tokens(none, str(tmp_path / "none"), WORD)).count() == 0


def test_language(docs, none):
    profiles = langid.fit(docs.where("lang IS NOT NULL"))
    assert profiles.languages == ["de", "en"]
    out = langid.predict(docs, profiles)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    got = by_id(out, "lang_pred", "score")
    for i in (0, 1, 2, 13):
        assert got[i] == [("und", 0.0)]
    for i in (3, 7, 8, 14):
        assert got[i][0][0] in ("de", "en") and 0 <= got[i][0][1] <= 1
    assert len(set(got[9])) == 1 and len(got[9]) == 2
    assert langid.predict(none, profiles).count() == 0
    unlearned = langid.predict(docs, langid.fit(none))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_language_of_long_texts():
    """A text that is worked on in pieces has the vector of the whole one, in any script, wherever it is cut."""
    space = langid.Space(128, 7)
    texts = [LONG[:5000], "中文字符" * 900 + "!!  end", "नमस्ते दुनिया " * 200, " " * 4000 + "ab", "x" * 3000, "", "."]
    whole, has = langid.text_vectors(space, texts)
    assert has.tolist() == [True] * 5 + [False] * 2
    for size in (1, 2, 777, 1666):
        cut, found = langid.text_vectors(langid.Space(128, 7), texts, size)
        assert (cut == whole).all() and (found == has).all(), size


def test_language_vectors_by_brute_force(monkeypatch):
    texts = ["Aé b", "ba ab ba", "中文 abc 中文", "", "zz"]
    space = langid.Space(64, 3)
    vector = {c: space.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(int) for c in "aébcz中文 "}
    want = []
    for t in texts:
        padded = " " + t.lower() + " "
        want.append(sum((np.roll(vector[x], 2) * np.roll(vector[y], 1) * vector[z] for x, y, z in zip(padded, padded[1:], padded[2:], strict=False)), np.zeros(64, int)))
    assert (langid.text_vectors(space, texts)[0] == np.array(want)).all()
    monkeypatch.setattr(langid, "DENSE_CODES", 0)
    monkeypatch.setattr(langid, "KEPT", 3)
    monkeypatch.setattr(langid, "AT_ONCE", 2)
    assert (langid.text_vectors(space, texts)[0] == np.array(want)).all()
    assert len({tuple(v) for v in space.letter_vectors(np.arange(0x4E00, 0x5200))}) == 0x400


def test_language_model_is_bounded(docs):
    assert langid.fit(docs, most=1).languages == ["en"]


def test_quality(docs, none):
    out = quality.host_quality(docs, keep=docs.columns)
    got = by_id(out, "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, text, _, _ in ROWS:
        w = words(text)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        assert got[i][0][:2] == (len(w), sum(map(len, w))) and got[i][0][3] == len(covered), i
    assert not got[9][0][4] and got[12][0][4:] == (True, False)
    assert rows(out.select("row.*")) == rows(docs)
    assert quality.host_quality(none).count() == 0


def test_quality_host_verdict(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    data = [(i, bad if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good, f"h{i % 40}") for i in range(400)]
    out = {r.doc_id: r for r in quality.host_quality(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert not out[0].base_failed and not out[0].kept and out[0].host_rate > 0.75
    assert all(r.kept for i, r in out.items() if i >= 1000)
    assert quality.beta_prior(None, None) == (0.5, 0.5)


def test_quality_repeats_with_equal_hash_bits(spark):
    """The windows of these words agree in 40 bits of their hash, and the one between the two equal ones differs."""
    text = "u227827 q z u4262416 q z u227827 q z"
    out = quality.with_measures(spark.createDataFrame([(1, text), (2, text + " a b"), (3, "u227827 q z u4262416 q z")], "doc_id long, text string"), ["doc_id"])
    assert by_id(out, "n_repeat_words") == {1: [(6,)], 2: [(6,)], 3: [(0,)]}


def test_quality_verdicts_without_broadcast(docs, monkeypatch):
    whole = rows(quality.host_quality(docs))
    monkeypatch.setattr(quality, "is_small", lambda df: False)
    assert rows(quality.host_quality(docs)) == whole


def test_quality_repeats_by_brute_force(spark):
    random.seed(3)
    data = [(i, " ".join(random.choice("abcd") for _ in range(random.randint(0, 60)))) for i in range(200)]
    got = {r.doc_id: r.n_repeat_words for r in quality.with_measures(spark.createDataFrame(data, "doc_id long, text string"), ["doc_id"]).collect()}
    for i, text in data:
        w = text.split()
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert got[i] == len({k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)})


def brute_components(data):
    return sorted(((doc, len(shingle_set(t)), c) for (doc, t), c in zip(data, components_of(data), strict=True)), key=repr)


def test_jaccard_edges(docs, none):
    got = rows(paritysketch.similar_components(docs).select("doc_id", "n_shingles", "component_id"))
    assert got == brute_components([(i, t) for i, t, _, _ in ROWS])
    assert paritysketch.similar_components(none).count() == 0
    stay = paritysketch.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(["None", *map(str, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14])])
    assert paritysketch.one_of_each(none).count() == 0


def test_jaccard_by_brute_force(spark):
    """Families of near copies around the threshold, in sizes that lie on both sides of the bands' borders."""
    random.seed(11)
    data = []
    for size in (5, 8, 9, 15, 17, 30, 36, 64, 70, 130):
        base = [f"b{size}_{k}" for k in range(size)]
        for _ in range(14):
            text = list(base)
            for _ in range(random.randint(0, max(1, size // 40))):
                k = random.randrange(len(text))
                action = random.random()
                if action < 0.4:
                    text[k] = f"x{random.random()}"
                elif action < 0.7:
                    del text[k:]
                else:
                    text += [f"y{random.random()}"] * random.randint(1, max(1, size // 10))
            data.append((len(data), " ".join(text)))
    got = rows(paritysketch.similar_components(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).select("doc_id", "n_shingles", "component_id"))
    want = brute_components(data)
    assert got == want
    assert 20 < len({c for _, _, c in want}) < len(data) - 20


def family(size, copies, seed):
    """Near copies of a text of ``size`` words, some within the threshold of one another and some beyond."""
    random_ = random.Random(seed)
    base = [f"b{seed}_{k}" for k in range(size)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(random_.choice([0, size // 100, size // 60, size // 40, size // 20])):
            text[random_.randrange(size)] = f"x{random_.random()}"
        out.append(" ".join(text))
    return out


def test_jaccard_of_large_sets(spark):
    """Sets of some thousand shingles: sketches of unrelated ones, or of ones below the threshold, still differ in more bits than linked ones may."""
    texts = [t for size, seed in ((5000, 1), (5000, 2), (9000, 3), (4100, 4)) for t in family(size, 7, seed)]
    data = list(enumerate(texts))
    got = rows(paritysketch.similar_components(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id"))
    assert got == brute_components(data)
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 63, 5000).astype(np.uint64)) for i in range(2)]
    one, other = paritysketch.sketches([paritysketch.sketch_of(x) for x in sets])
    assert np.bitwise_count(one ^ other).sum() > 1.5 * paritysketch.most_different(5000, 5000, 80)
    small = paritysketch.sketches([paritysketch.sketch_of(x) for x in (sets[0], sets[0][:100])])
    assert small.shape[1] * 64 == paritysketch.SKETCH_BITS and np.bitwise_count(small[0] ^ small[1]).sum() <= 4900


def test_jaccard_in_split_blocks(spark, monkeypatch):
    """Blocks that take several rows and several tasks; different sets with one name get others."""
    monkeypatch.setattr(paritysketch, "MEMBERS", 3)
    monkeypatch.setattr(paritysketch, "ASKING", 2)
    monkeypatch.setattr(paritysketch, "GROUPED", 50)
    names = paritysketch.shingles.set_names
    monkeypatch.setattr(paritysketch.shingles, "set_names", lambda x, seed=0: (names(x, seed)[0] % (2 if seed == 0 else 1 << 62), names(x, seed)[1]))
    data = list(enumerate(t for seed in (1, 2) for t in family(120, 40, seed)))
    out = paritysketch.similar_components(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id")
    want = brute_components(data)
    assert rows(out) == want and 4 < len({c for _, _, c in want}) < 70


def test_block_distance_is_bounded():
    """Two sets that differ in few enough elements always agree on an entered block."""
    random.seed(2)
    for size in (1, 2, 3, 4, 7, 8, 20, 100, 257):
        for _ in range(40):
            a = {random.getrandbits(63) for _ in range(size)}
            b = set(a)
            for _ in range(random.randint(0, size // 4 + 1)):
                if random.random() < 0.5 and len(b) > 1:
                    b.remove(next(iter(b)))
                else:
                    b.add(random.getrandbits(63))
            if 100 * len(a & b) >= 80 * len(a | b):
                sets = [np.array(sorted(s), np.uint64) for s in (a, b)]
                which, names = paritysketch.signatures(sets, 80)
                assert set(names[which == 0]) & set(names[which == 1])


def test_mixture(docs, none):
    out = mixing.mix(docs, keep=docs.columns)
    assert rows(out.select("row.*")) == rows(docs)
    got = out.collect()
    assert all(r.taken == r.copies * r.size and r.taken <= 2 * r.size for r in got)
    assert [r.size for r in got if r.doc_id in (0, 1, 2)] == [0, 0, 0]
    assert rows(mixing.mix(docs).select("doc_id", "taken")) == rows(mixing.mix(docs.repartition(2)).select("doc_id", "taken"))
    assert mixing.mix(none).count() == 0


def test_mixture_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 500, None: 50}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        rate = (left - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        over = {s for s in sizes if s not in full and rate * weights[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in sizes:
        assert got[s] == pytest.approx(2 * sizes[s] if s in full else rate * weights[s])


def spark_hash(*values):
    """Spark's xxhash64 of long, string and (as a pair) int values."""
    import xxhash

    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64(data, seed=h).intdigest()
    return h


def brute_mixture(data, targets, seed=20240229):
    """Copies of each (id, text, source) by sorting whole sources by the sampling key."""
    copies = {}
    for source in {s for _, _, s in data}:
        mine = []
        for doc, text, s in data:
            if s == source:
                symbols = sum(text.count(c) for c in mixing.SYMBOLS)
                u = ((spark_hash(doc, text, (seed,)) >> 11) + 0.5) / 2**53
                mine.append((-np.log(u) / max(0.1, 1 - 5 * symbols / max(1, len(text.encode()))), doc, len(words(text))))
        size = sum(n for _, _, n in mine)
        epochs = int(targets[source] // size)
        rest, so_far = targets[source] - epochs * size, 0
        going = True
        for _, doc, n in sorted(mine):
            going = going and so_far + n / 2 <= rest
            copies[doc] = epochs + going
            so_far += n
    return copies


@pytest.mark.parametrize("leaf,slice_bits", [(mixing.LEAF, mixing.SLICE_BITS), (3, 2)])
def test_mixture_by_brute_force(spark, monkeypatch, leaf, slice_bits):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "SLICE_BITS", slice_bits)
    random.seed(6)
    data = [(i, " ".join(random.choice(["w", "w#", "##", "word"]) for _ in range(random.randint(1, 30))), random.choice(["a", "a", "b", "c", None])) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)).collect()
    sources = {i: s for i, _, s in data}
    assert {r.doc_id: r.copies for r in got} == brute_mixture(data, {sources[r.doc_id]: r.target for r in got})


def test_mixture_prefers_quality_and_hits_targets(spark):
    clean, dirty = " ".join(["word"] * 50), " ".join(["w###"] * 50)
    data = [(i, dirty if i % 2 else clean, "a" if i < 2000 else "b") for i in range(2400)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), weights=(1, 9)).collect()
    a = [r for r in got if r.doc_id < 2000]
    assert sum(r.taken for r in a) == pytest.approx(a[0].target, rel=0.02)
    good, poor = (sum(r.copies for r in a if r.doc_id % 2 == k) for k in (0, 1))
    assert 1000 <= poor < good <= 2000 and a[0].target > 1.2 * a[0].source_size  # an epoch of all, then mostly clean ones
    assert good - 1000 > 2 * (poor - 1000)


def test_mixture_splits_equal_rows(spark):
    """A source of equal rows meets its target, in whatever share the cut falls among them."""
    data = [(7, "one two three four five", "b")] * 1000 + [(i, "w " * 40, "a") for i in range(200)] + [(i, "w " * 25, "c") for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(df, keep=["doc_id", "text"])
    got = out.collect()
    assert len(got) == len(data) and rows(out.select("row.text", "doc_id")) == sorted(((t, i) for i, t, _ in data), key=repr)
    for source_size in (5000, 8000, 10000):
        mine = [r for r in got if r.source_size == source_size]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=max(r.size for r in mine)), source_size
    assert {r.copies for r in got if r.source_size == 5000} == {1, 2}


def test_urls(spark):
    given = [None, "", "no host", "HTTP://A.Example.ORG/es/1?x#y", "https://x.com/fr/a", "https://x.com/de/b", "https://x.com", "https://example.org/en/19", "ftp://net/a/b/c/d/e/f", "https://x.com/de/b", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(given)] + [(None, "https://x.com/en/*", 1)], "page_id long, url string, host int")
    rules = [urls.Rule("org/", True), urls.Rule("example.org/es/", False), urls.Rule("example.org/en/1", False), urls.Rule("com/fr/", True), urls.Rule("com/de/", False)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5] == got[9] == ("x.com", "/de/b", "com/de/", "block")
    assert got[6][:3] == ("x.com", "", None) and got[7][2:] == ("example.org/en/1", "block") and got[8][:2] == ("net", "/a/b/c/d/e/f") and got[10][:2] == ("b:", "//c/d")
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert urls.judge_urls(df, []).where("verdict = 'block'").count() == 0


def test_url_templates_learn_from_labels(spark):
    """Ids become wildcards, a branch whose labels differ stays apart and is rejected for pages that no rule names."""
    bad = [f"http://h.com/spam/{i}/x" for i in range(60)] + [f"http://h.com/spam/{i}/y" for i in range(60, 90)]
    good = [f"http://h.com/news/{i}/x" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    rules = [urls.Rule(f"h.com/spam/{i}/", False) for i in range(50)] + [urls.Rule("h.com/news/1", True), urls.Rule("h.com/news/2", True)]
    got = {r.page_id: r for r in urls.judge_urls(df, rules).collect()}
    assert got[80].rule is None and got[80].verdict == "block" and got[80].template == "/spam/*/*"
    assert got[120].rule is None and got[120].verdict == "allow"


def brute_templates(pages, rules, settings=urls.TreeSettings()):
    """Template of each (host, path) by a recursive tree over lists of paths."""
    blocked = {r.pattern: not r.allow for r in rules}
    found = {}

    def grow(host, mine, depth, template):
        kids = {}
        for path, segments, label in mine:
            if len(segments) <= depth:
                found[host, path] = template
            else:
                kids.setdefault(segments[depth], []).append((path, segments, label))
        inner = [x for kid in kids.values() for x in kid]
        labels = [x[2] for x in inner if x[2] is not None]
        share = (sum(labels) + 1) / (len(labels) + 2)
        others = []
        for segment, kid in kids.items():
            known = [x[2] for x in kid if x[2] is not None]
            variable = len(kids) > settings.min_children and len(kid) < settings.max_child_share * len(inner)
            alike = not known or abs(sum(known) / len(known) - share) <= settings.z * (share * (1 - share) / max(len(known), 1)) ** 0.5
            if not variable and (not alike or len(kids) == 1):
                grow(host, kid, depth + 1, f"{template}/{segment}")
            else:
                others += kid
        if others:
            grow(host, others, depth + 1, f"{template}/*")

    hosts = {}
    for host, path, rule in pages:
        segments = path.removeprefix("/").replace("*", "%2A").split("/") if path else []
        hosts.setdefault(host, []).append((path, segments, None if rule is None else int(blocked[rule])))
    for host, mine in hosts.items():
        grow(host, mine, 0, "")
    return found


def test_url_trees_by_brute_force(spark):
    """Seven levels, of which the sixth tells good from bad; repeated pages, very long urls, hosts without labels."""
    random.seed(9)
    given = [f"http://h.com/a/b/{i % 40}/c/{i % 3}/{'bad' if i % 2 else 'good'}/{i}" for i in range(400)] + [f"http://h.com/a/b/{i % 40}/c" for i in range(30)]
    given += [f"http://n.net/{random.choice('ab')}/{random.choice('xyz')}/same/{random.choice('pq')}" for _ in range(60)] + ["http://one.net/" + "x/" * 400, "http://h.com/" + "y/*/" * 300]
    given += [f"http://k.org/{random.choice('ab')}/{random.randint(0, 3)}" for _ in range(120)]
    rules = [urls.Rule(f"h.com/a/b/{i}/c/{k}/bad/", False) for i in range(20) for k in range(3)] + [urls.Rule(f"h.com/a/b/{i}/c/{k}/good/", True) for i in range(20) for k in range(3)] + [urls.Rule("k.org/a/", False), urls.Rule("k.org/b/1", True)]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string").repartition(3), rules).collect()
    want = brute_templates([(r.host, r.path, r.rule) for r in got], rules)
    assert len(got) == len(given) and {(r.host, r.path): r.template for r in got} == want
    verdicts = {r.page_id: (r.rule, r.verdict, r.template) for r in got}
    assert verdicts[25] == (None, "block", "/*/*/*/*/*/bad/*") and verdicts[26] == (None, "allow", "/*/*/*/*/*/good/*")


def brute_windows(spark, talk, settings=chat.Windows()):
    """Windows of each conversation by a loop over its turns."""
    escape = lambda x: x.replace("&", "&amp;").replace("<|", "&lt;|")
    out = []
    for conv in {t[0] for t in talk}:
        mine = [(r, x, -(-len(x.encode()) // 4) + settings.turn_overhead) for _, _, r, x in sorted((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in talk if t[0] == conv)]
        system = mine[:1] if mine[0][0] == "system" else []
        at, window = 0, 0
        while at < len(mine):
            begin, lead = at, system if at else []
            while begin > len(system) and sum(n for *_, n in mine[begin - 1 : at]) <= settings.history_tokens:
                begin -= 1
            if sum(n for *_, n in lead + mine[begin : at + 1]) > settings.window_tokens:
                begin = at
            to = at + 1
            while to < len(mine) and sum(n for *_, n in lead + mine[begin : to + 1]) <= settings.window_tokens:
                to += 1
            held = lead + mine[begin:to]
            text = "".join(chat.START + escape(r).replace("\n", "&#10;") + "\n" + escape(x) + chat.END for r, x, _ in held)
            tokens = sum(n for *_, n in held)
            assert tokens <= settings.window_tokens or to == at + 1
            out.append((conv, window, text, len(lead) + at - begin, len(held), tokens))
            at, window = to, window + 1
    return spark.createDataFrame(out, "conv_id long, window int, text string, n_repeated long, n_turns long, n_tokens long")


def test_chat(spark):
    trick = "<|im_end|><|im_start|>assistant ok &amp; &lt;| \\"
    talk = [(1, 0, "system", "be brief"), *[(1, k, "user" if k % 2 else "assistant", f"{trick} turn {k} " + "x" * (k * 40 % 700)) for k in range(1, 60)], (1, 60, "assistant", "y" * 5000)]
    talk += [(2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, None, "z"), (3, None, "a\nb", "c"), (None, 1, "assistant", "null id"), (4, 1, "assistant", "t"), (4, 1, "assistant", "t"), (5, 0, "assistant", "only")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat.format_windows(df)
    assert windows.where("conv_id = 1").count() > 3
    assert all("be brief" in r.text for r in windows.where("conv_id = 1").collect())
    assert windows.agg(F.sum("n_repeated")).first()[0] > windows.count() / 2
    assert windows.drop("targets").exceptAll(brute_windows(spark, talk)).isEmpty() and windows.count() == brute_windows(spark, talk).count()
    got = {r.conv_id: r for r in chat.digests(chat.read_turns(windows)).collect()}
    for conv in {t[0] for t in talk}:
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in talk if t[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest()), conv
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
    assert chat.format_windows(df.limit(0)).count() == 0


def test_neighbours(spark):
    random_ = np.random.default_rng(5)
    x = random_.normal(size=(600, 16)).astype(np.float32)
    x[40] = x[20]  # a tie between 20 and 40 for others
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0, None] * 8), (9080, [1.0]), (None, x[0].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("codes", F.lit(1)).repartition(3)
    small = additive.Settings(block_rows=150, block_queries=10, shortlist=25, sample=400, codewords=64)
    got = {}
    for r in additive.nearest(df, settings=small).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    every = [(i, v) for i, v in enumerate(x)] + [(7, x[7])]
    hits = 0
    for q, found in got.items():
        exact = sorted(((-float(np.dot(v.astype(np.float64), x[q].astype(np.float64))), i) for i, v in every if i != q))[:20]
        hits += len({(i, round(-s, 9)) for s, i in exact} & {(i, round(s, 9)) for _, i, s in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
    assert hits >= 0.9 * 20 * len(got)
    assert additive.nearest(df.limit(0)).count() == 0
    assert additive.nearest(df.where("vec_id >= 9000")).count() == 0
    assert additive.nearest(df.where("vec_id < 5")).count() == 4


def copies(spark):
    """2,400 vectors with groups of 800 exact and 800 near copies, the ids and embeddings as a table, and brute-force neighbours."""
    random_ = np.random.default_rng(8)
    x = random_.normal(size=(2400, 16)).astype(np.float32)
    x[random_.permutation(2400)[:800]] = x[0]
    near = random_.permutation(2400)[:800]
    x[near] = x[1] + random_.normal(scale=0.002, size=(800, 16)).astype(np.float32)
    x[[0, 100, 200]], x[[300, 400]] = x[0], x[near[:2]]
    want = {}
    for q in range(0, 2400, 100):
        exact = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
        want[q] = [int(i) for i in np.argsort(-exact, kind="stable") if i != q][:20]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3), want


def neighbours(df, settings):
    got = {}
    for r in additive.nearest(df, every=100, settings=settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_neighbours_in_large_groups_of_copies(spark):
    """Groups of exact and near copies above the shortlist, in several blocks: with a wide margin all ids are those of brute force."""
    df, want = copies(spark)
    assert neighbours(df, additive.Settings(block_rows=1200, shortlist=40, sample=400, codewords=64, spread=12)) == want


def test_neighbours_recall_with_copies(spark):
    """The same with the query's own settings: recall by id of 0.9 or more for queries in the groups of copies and outside."""
    df, want = copies(spark)
    got = neighbours(df, additive.Settings())
    recall = {q: len(set(got[q]) & set(want[q])) / 20 for q in want}
    exact = {q for q, found in want.items() if 0 in found or q in (0, 100, 200)}
    assert sorted(got) == sorted(want) and exact
    for queries in (exact, set(want) - exact):
        assert sum(recall[q] for q in queries) >= 0.95 * len(queries), recall


def test_beam_search_is_better_than_greedy():
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(800, 16)).astype(np.float32)
    quantiser = additive.Quantiser.fit(x, additive.Settings(codebooks=4, codewords=32, sample=800))
    loss = [float(((x - quantiser.decode(quantiser.encode(x, beam))) ** 2).sum()) for beam in (1, 8)]
    assert loss[1] < loss[0]
    q = random_.normal(size=(3, 16)).astype(np.float32)
    codes = quantiser.encode(x, 4)
    assert np.allclose(quantiser.scores(q, codes), quantiser.decode(codes) @ q.T, atol=1e-3)
