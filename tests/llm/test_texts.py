"""Packing, BPE, language identification and the language model against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from conftest_llm import given

from memlake.llm import bpe, kneser_ney, langid, packing

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_pieces_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = defaultdict(list)
    for r in packing.pieces(docs, WORDS, size=100, with_ids=True).collect():
        got[r["doc_id"]].append(r)
    copies = Counter(i for i, _ in given(docs))
    for i, text in given(docs):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(got[i], key=lambda r: r["piece"])
        assert len(own) == copies[i] * -(-len(ids) // 100)
        for r in own:
            part = ids[100 * r["piece"] :][:100]
            assert (r["start"], r["length"], r["ids"], r["ids_crc32"]) == (100 * r["piece"], len(part), part.tobytes(), zlib.crc32(part.tobytes()))


def test_hard_words_are_the_tokenizers():
    ids = packing._Ids(WORDS)
    text = "İx ½ don't I'll x² naïve\x85b\xa0c ΣΑΣ ŉ a_b__c 12ab34 \x00\x7f 日本語 é ª_º ʼn ÀÉ ß ſ"
    words = text.encode().split()
    ids.learn(words)
    assert b"".join(map(ids.__getitem__, words)) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(docs):
    rows = packing.packed(docs, WORDS, 256).collect()
    cut = packing.pieces(docs, WORDS, 256)
    assert Counter((r["doc_id"], r["piece"]) for r in rows) == Counter((r["doc_id"], r["piece"]) for r in cut.collect())
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] and sum(x for _, x in own) <= 256
    assert len(by) <= math.ceil(sum(r["length"] for r in rows) / 256) + 2


def test_plan_places_everything():
    rng = np.random.default_rng(0)
    for lengths in (np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 2048), [2048] * 5, [1025] * 7, [1], []):
        want = Counter(int(x) for x in lengths)
        kinds = packing.plan(dict(want))
        placed = Counter()
        for many, own in kinds:
            assert many > 0 and sum(own) <= 2048
            for x in own:
                placed[x] += many
        assert placed == want
    assert sum(m for m, _ in packing.plan({1025: 7})) == 7


def test_nnls_and_patterns():
    assert sorted(packing.patterns(6)) == sorted([(6,), (5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2)])
    rng = np.random.default_rng(2)
    a, x = rng.random((8, 20)), np.zeros(20)
    x[[1, 5, 9]] = 1, 2, 3
    found = packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-6


def test_bpe(docs):
    import tiktoken

    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})
    encoded = bpe.encode(docs, BYTES, public_tokenizers.PATTERN, starts=True)
    got = defaultdict(list)
    for r in encoded.collect():
        got[r["doc_id"]].append(r)
    texts = given(docs)
    for i, text in texts:
        ids = exact.encode_ordinary(text)
        for r in got[i]:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids
            lengths = [len(exact.decode_single_token_bytes(k)) for k in ids]
            assert np.frombuffer(r["starts"], "<u4").tolist() == [sum(lengths[:k]) for k in range(len(ids))] if len(ids) < 500 else True
    back = bpe.decode(encoded, BYTES, public_tokenizers.PATTERN, parts=True).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == Counter((i, t.encode()) for i, t in texts)
    assert all("".join(r["parts"]) == bytes(r["decoded"]).decode() and len(r["parts"]) == len(r["ids"]) // 4 for r in back)


def test_bpe_repeats():
    """Units with repeated pieces, where pairs of one token may overlap, and others, against the tiktoken library."""
    import tiktoken

    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})
    codec, rng = bpe.Codec(BYTES, public_tokenizers.PATTERN), random.Random(3)
    units = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for letters in ("a", "ab", "=-", " x", "é日a", "aeinrst", "\n ", "0123") for _ in range(150)]
    units += ["banana", "ababa" * 30, "z" * 5000, "", "Mississippi", "don't"]
    units = [u for text in units for u in codec.units(text)]
    assert 20 < sum(map(codec.ambiguous, units)) < len(units) / 2 and bpe.overlaps({b"a": 0, b"aa": 1}) is None
    once = codec.learn(units)
    for u in units:
        assert np.frombuffer(once.get(u) or codec.kept[u], "<u4").tolist() == codec.by_rank(u) == exact.encode_ordinary(u), u


def test_bpe_units_and_split_characters():
    import tiktoken

    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})
    codec = bpe.Codec(BYTES, public_tokenizers.PATTERN)
    for text in ("a  b \n c", "  x", "x  ", "\n \n", "a  b", "aaaa aaaaaaa" * 20, "don't  I'LL", "日本 語", " \x1c x", "1234 5"):
        units = codec.units(text)
        once = codec.learn(units)
        made = b"".join(codec.kept.get(u) or once[u] for u in units if u)
        assert "".join(units) == text and np.frombuffer(made, "<u4").tolist() == exact.encode_ordinary(text)
    assert bpe.shown(["日".encode()[:1], "日".encode()[1:], b"\xff"]) == ["", "日", "�"]


def test_language(spark, docs):
    import random

    rng = random.Random(0)
    alphabets = {"aa": "abcdeé", "bb": "fghijü", "cc": "кирилц"}
    rows = [(k, " ".join("".join(rng.choices(alphabets[x], k=5)) for _ in range(30)), x) for k in range(90) for x in [sorted(alphabets)[k % 3]]]
    rows += [(90, None, "aa"), (91, "", "bb"), (92, "12 34 %%", None), (93, "abc", None), (94, "fgh " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df.where("doc_id < 60"))
    counts = Counter(g for _, t, x in rows[:60] if x == "aa" for g in langid.grams(t).tolist())
    want = sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]
    assert [r["gram"] for r in profiles.where("lang = 'aa'").orderBy("rank").collect()] == want
    got = {r["doc_id"]: r for r in langid.predict(df, profiles).collect()}
    assert all(got[k]["lang_pred"] == rows[k][2] for k in range(90)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[k]["lang_pred"] for k in (90, 91, 92, 93, 94)] == ["und", "und", "und", "aa", "bb"]
    assert langid.predict(docs, profiles).count() == docs.count()
    none = langid.learn_profiles(df.where("false"))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}


def brute_profiles(rows, size):
    """lang: its most frequent n-grams in order, from texts word by word."""
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    return {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]] for lang, c in counts.items()}


def brute_grams(text):
    """n-grams as their characters' numbers before and after a word's edges; fewer characters have smaller numbers."""
    for word in re.findall(r"[^\W\d_]+", text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
        yield from ((0, 0, ord(c)) for c in low)
        edged = [ord(c) for c in f"_{low}_"]
        yield from ((0, a, b) for a, b in zip(edged, edged[1:]))
        yield from (tuple(edged[k : k + 3]) for k in range(len(edged) - 2))


def test_language_by_brute_force(spark):
    """Profiles, distances, predictions and scores, learnt again by plain counting."""
    rng = random.Random(3)
    letters = {"en": "etaoinshrdlu", "de": "enisratdhulö", "fr": "esaitnruléàç"}
    rows = []
    for k in range(60):
        lang = rng.choice(list(letters))
        mixed = letters[lang] if k % 3 else "".join(letters.values())
        words = ["".join(rng.choice(mixed[: rng.randint(3, 12)]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 60))]
        rows.append((k, " ".join(w.title() if k % 2 else w for w in words), lang if k % 5 else None))
    rows += [(60, None, "en"), (61, "", "de"), (62, "12 34!", "fr"), (63, "ab " * 2000, "en"), (None, rows[1][1], "en"), rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    size = 40
    profiles = langid.learn_profiles(df, size)
    want = brute_profiles([(t, lang) for _, t, lang in rows], size)
    got = {}
    for r in profiles.orderBy("lang", "rank").collect():
        got.setdefault(r["lang"], []).append(tuple(r["gram"] >> s & (1 << 21) - 1 for s in (42, 21, 0)))
    assert got == want

    def predicted(text):
        top = [g for g, _ in sorted(Counter(brute_grams(text or "")).items(), key=lambda x: (-x[1], x[0]))[:size]]
        if not top:
            return "und", 0.0
        sums = {lang: sum(min(abs(own.index(g) - k), size) if g in own else size for k, g in enumerate(top)) for lang, own in want.items()}
        best = min(sums, key=lambda lang: (sums[lang], lang))
        return best, round(1 - sums[best] / (size * len(top)), 12)

    made = sorted((repr(r["doc_id"]), r["lang_pred"], round(r["score"], 12)) for r in langid.predict(df, profiles, size).collect())
    assert made == sorted((repr(k), *predicted(t)) for k, t, _ in rows)


def test_grams():
    assert sorted(map(langid.shown, langid.grams("Ab, c"))) == sorted(["a", "b", "_a", "ab", "b_", "_ab", "ab_", "c", "_c", "c_", "_c_"])
    assert not len(langid.grams("1 2 %")) and langid.shown(int(langid.grams("𝐀")[0])) == "𝐀"


def test_language_model(docs):
    known = docs.where("doc_id % 3 <> 1 or doc_id is null")
    split = lambda t: [*t.encode().lower().split(), None]
    pairs = Counter()
    for _, t in given(known):
        pairs.update(zip([0, *split(t)[:-1]], split(t), strict=True))
    count, seen, total, ns = Counter(), Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, w), c in pairs.items():
        count[w] += c
        seen[w] += 1
        total[v] += c
        ns[v][min(c, 3) - 1] += 1
    of = lambda x: [sum(y == k for y in x) for k in (1, 2, 3, 4)]
    d2, d1, n, v_ = kneser_ney.discounts(of(pairs.values())), kneser_ney.discounts(of(seen.values())), sum(count.values()), len(count)
    unknown = sum(d1[min(x, 3) - 1] for x in seen.values()) / len(pairs) / (v_ + 1)

    def probability(v, w):
        low = unknown + ((seen[w] - d1[min(seen[w], 3) - 1]) / len(pairs) if seen[w] else 0)
        if not total[v]:
            return low
        c = pairs[v, w]
        return ((c - d2[min(c, 3) - 1]) if c else 0) / total[v] + sum(a * b for a, b in zip(d2, ns[v], strict=True)) / total[v] * low

    # after any context the probabilities of all words and of one unknown sum to 1
    for v in (0, b"w1", b"never"):
        assert abs(sum(probability(v, w) for w in [*count, "?"]) - 1) < 1e-9
    model = kneser_ney.train(known)
    got = defaultdict(list)
    for r in kneser_ney.score(docs, model).collect():
        got[r["doc_id"]].append(r)
    for i, t in given(docs):
        w = split(t)
        base = sum(math.log10((count[x] + 1) / (n + v_ + 1)) for x in w)
        score = sum(math.log10(probability(a, b)) for a, b in zip([0, *w[:-1]], w, strict=True))
        for r in got[i]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_empty_tables(empty, docs):
    assert packing.packed(empty, WORDS).count() == 0
    assert bpe.decode(bpe.encode(empty, BYTES, public_tokenizers.PATTERN), BYTES, public_tokenizers.PATTERN).count() == 0
    model = kneser_ney.train(empty)
    assert kneser_ney.score(empty, model).count() == 0
    assert {r["score"] for r in kneser_ney.score(docs.limit(5), model).collect()} == {0.0}
