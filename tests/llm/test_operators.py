"""Secrets, packing, language, quality, audio and byte BPE against plain versions, round trips and held-out rows."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from awkward_tables import words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm import language_id, mpeg_audio, packing, quality
from tallybook.llm.byte_bpe import bpe_decode, bpe_encode, load
from tallybook.llm.secret_scan import REACH, listed, redact_secrets, scan_secrets

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


#: The patterns of the contract and of weak parts, written anew: kind, role, pattern, least length of its group.
ASSIGNED = "[\"']? *[:=] *[\"']?"
PLAIN = (
    ("assign", "secret", "(?ai:password|passwd|secret|token|api_?key)" + ASSIGNED + "([A-Za-z0-9+/_.=-]+)", 12, 1),
    ("access", "identifier", "AKIA[A-Z0-9]+", 18, 0),
    ("hex", "secret", "[0-9a-f]+", 16, 0),
    ("identifier", "identifier", "(?ai:user|username|login|account|client_?id)" + ASSIGNED + r"[A-Za-z0-9_.@-]+|[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1, 0),
    ("endpoint", "endpoint", "[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\\x00-\\x20\"'<>]+", 1, 0),
    ("weak", "secret", "(?ai:password|passwd|secret|token|api_?key|pwd|credentials?)" + ASSIGNED + "([^\\x00-\\x20\"']+)", 6, 1),
)


def brute_spans(text):
    """Base spans and all spans by plain loops: only the distance of parts decides."""
    text, parts = text or "", []
    for rank, (_, role, pattern, least, group) in enumerate(PLAIN):
        parts += [(m.start(), rank, m.end(), role) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    assigns = [p for p in parts if p[1] == 0]
    parts = [p for p in parts if p[1] != 5 or not any(a[0] < p[2] and p[0] < a[2] for a in assigns)]
    base = sorted(p for p in parts if p[1] < 3)
    linked = [w for w in parts if w[1] >= 3 and any((w[3] == "secret") != (p[3] == "secret") and p[0] <= w[2] + 200 and p[2] >= w[0] - 200 for p in parts)]
    text_of = lambda found: ",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e, _ in sorted(found))
    return text_of(base), text_of(base + linked)


def test_secrets(awkward, rows):
    got = scan_secrets(awkward).select("doc_id", "text", listed("base").alias("b"), listed("spans").alias("s"))
    assert Counter((r.doc_id, r.b, r.s) for r in got.collect()) == Counter((i, *brute_spans(t)) for i, t in rows)


def test_weak_secrets_need_a_partner(rows):
    by = dict(rows)
    assert brute_spans(by[61]) == ("", "") and "weak" in brute_spans(by[60])[1] and "endpoint" in brute_spans(by[60])[1]


def test_only_the_distance_of_parts_decides(spark):
    """Parts whose starts lie several scopes apart, shifted over the grid of scopes; the last ones are out of reach."""
    endpoint = "https://" + "z" * 52
    cases = [endpoint + " " * REACH, "https://" + "u" * 600 + "  ", "mail@" + "m" * 900 + ".example " + " " * 150, endpoint + " " * (REACH + 1)]
    docs = spark.createDataFrame([(1000 * i + shift, "\n" * shift + case + "password=short7") for i, case in enumerate(cases) for shift in range(0, 2 * REACH, 7)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in scan_secrets(docs).select("doc_id", listed("spans").alias("s")).collect()}
    for i, case in enumerate(cases):
        for shift in range(0, 2 * REACH, 7):
            at, end = shift + len(case), shift + len(case.rstrip())
            near = f"{'identifier' if i == 2 else 'endpoint'}:{shift}:{end},weak:{at}:{at + 15}"
            assert got[1000 * i + shift] == ("" if i == 3 else near)


def test_secrets_of_random_texts(spark):
    """Long parts, parts at any distance, several in a row and overlapping kinds."""
    draw = random.Random(11)
    pieces = ["password=short7", "token: " + "k" * 40, "AKIA" + "Q" * 20, "0123456789abcdef" * 3, "user = bob", "a.b@c.example.com", "https://" + "u" * 5000, "pwd='" + "p" * 3000 + "'", "secret:0123456789abcdef0123", "ſecret=short7", "é" * 50]
    rows = [(i, "".join(draw.choice(pieces) + draw.choice([" ", "\n", " " * draw.randrange(420), "x" * draw.randrange(60)]) for _ in range(draw.randrange(9)))) for i in range(300)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", listed("base").alias("b"), listed("spans").alias("s"))
    assert {(r.doc_id, r.b, r.s) for r in got.collect()} == {(i, *brute_spans(t)) for i, t in rows}


def test_texts_full_of_secrets(spark):
    """300,000 matches in one text, and repetitions that would need a stack frame each."""
    hexes = " ".join(f"{i:032x}" for i in range(300_000))
    dots = "user=bob pwd: hunter22 a@b" + ".c" * 50_000
    docs = spark.createDataFrame([(1, hexes), (2, dots)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_secrets(docs).select("doc_id", "base", listed("spans").alias("s")).collect()}
    assert len(got[1].base) == 300_000 and got[1].base[-1].end == len(hexes)
    assert got[2].s == brute_spans(dots)[1]
    clean = {r.doc_id: r.text for r in redact_secrets(docs, mark="*").collect()}
    assert clean[1] == " ".join("*" * 300_000) and clean[2] == "* * *"


def test_redaction(awkward, rows):
    out = redact_secrets(awkward)
    assert out.columns == awkward.columns
    by = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert by[60] == "[SECRET]\n[SECRET]\n[SECRET]" and by[61] == "pwd: hunter22" and by[7] is None
    assert by[62] == "[SECRET]\" [SECRET] [SECRET]" and by[40] == dict(rows)[40]


def token_ids(text):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_keeps_every_token_once(awkward, rows):
    pieces = packing.pack_documents(awkward, WORD_BPE).collect()
    want = Counter((i, len(token_ids(t))) for i, t in rows)
    assert {(p.doc_id, p.doc_tokens) for p in pieces} == set(want)
    ids = {(i, len(token_ids(t))): token_ids(t) for i, t in rows}
    length = Counter()
    for p in pieces:
        some = ids[p.doc_id, p.doc_tokens][p.start : p.start + p.length]
        assert len(some) == p.length
        if p.doc_id is not None:  # rows of null id may have equal lengths
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *some))
        length[p.doc_id, p.doc_tokens] += p.length
    assert length == Counter({k: k[1] * n for k, n in want.items()})
    fill = defaultdict(list)
    for p in pieces:
        fill[p.sequence_id].append((p.offset, p.length))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(sum(n for _, n in parts) < 2048 for parts in fill.values()) <= 1


def test_ids_are_the_tokenizers():
    """Words by the shortcut give what the tokenizer gives the whole text, for odd letters, marks and special tokens."""
    draw, tokenizer, words_of = random.Random(4), Tokenizer.from_file(WORD_BPE), packing.Words(WORD_BPE)
    odd = ["\u0130", "\u0131", "\u0958", "\u0345", "\u00df", "e\u0301", "\u1e9e", "\u212a", "\u01c5", "\u0400", "\u0482", "\u02b0", "\u00aa", "\u4e2d", "\U0001f600", "\u00a0", "\x85", "\x1c", "\u2028", "\u0660", "\ufb01", "\u03a3"]
    parts = [*odd, *"abcXYZ019.,!?'\"#-_/()<|>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "'s", "'LL", "word", " ", "\n", "\t "]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 14))) for _ in range(100_000)]
    got = words_of.encode(texts)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(g == struct.pack(f"<{len(w.ids)}I", *w.ids) for g, w in zip(got, want))
    assert np.frombuffer(words_of.encode(["a<|endoftext|>b"])[0], "<u4").tolist() == [320, 49407, 321]


def test_other_tokenizers_take_whole_texts():
    """The shortcut by words is for the known split alone."""
    other = packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
    text = "two  spaces and <|endoftext|>"
    assert not other.known_split and np.frombuffer(other.encode([text])[0], "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ranked", [3, 2000])
def test_lengths_that_many_share_are_ranked_in_parts(spark, monkeypatch, ranked):
    """Equal lengths, full windows and repeated rows are placed once each, however few are ranked together."""
    monkeypatch.setattr(packing, "RANKED", ranked)
    docs = spark.createDataFrame([(1, "same words here")] * 20 + [(None, "same words here")] * 20 + [(i, "word " * 130) for i in range(20)], "doc_id long, text string").repartition(5)
    pieces = packing.pack_documents(docs, WORD_BPE, window=32).collect()
    places = [(p.sequence_id, p.offset + i) for p in pieces for i in range(p.length)]
    assert len(places) == len(set(places)) == 40 * 4 + 20 * 131
    assert max(q for q, _ in places) + 1 == -(-len(places) // 32)


def test_plan_uses_each_remainder_once():
    draw = np.random.default_rng(5)
    histogram = np.bincount(draw.integers(1, 64, 3000), minlength=65)
    plan = packing.make_plan(histogram)
    length = np.repeat(np.arange(65), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram])
    fill = Counter()
    for i, start, n, sequence, _ in packing.place(plan, 64, length, rank):
        for q, k in zip(sequence.tolist(), n.tolist()):
            fill[q] += k
    assert sum(fill.values()) == length.sum() and max(fill.values()) <= 64 and sum(v < 64 for v in fill.values()) <= 1
    assert plan.placed.sum() > 0.8 * len(length)  # least squares places most, not the filling at the end


TONGUES = {"aa": "kolima retupo sendi", "bb": "grunt blisch wertz", "cc": "quero alado cion"}


def prose(lang, seed, n=120):
    draw, syllables = random.Random(f"{lang}{seed}"), TONGUES[lang].replace(" ", "")
    return " ".join("".join(syllables[(k := draw.randrange(len(syllables) - 2)) : k + 3] for _ in range(draw.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def tongues(spark):
    return spark.createDataFrame([(i, prose(lang, i), lang) for i, lang in enumerate(list(TONGUES) * 120)], "doc_id long, text string, lang string")


def test_languages_held_out(spark, tongues, awkward, rows):
    model = language_id.fit(tongues.where("doc_id div 3 % 3 <> 1"), train_docs=200)
    found = language_id.identify(tongues, model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.99 * len(found) and not any(r.rejected for r in found)
    odd = language_id.identify(awkward, model)
    added = ["lang_pred", "score", "cross_entropy", "rejected"]
    assert odd.columns == [*(c for c in awkward.columns if c not in added), *added] and {r.identified_text for r in odd.collect()} == {"x"}
    got = odd.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    noise = spark.createDataFrame([(1, "zzxq jjkw vvpf " * 40)], "doc_id long, text string")
    assert language_id.identify(noise, model).first().rejected


@pytest.mark.parametrize("first", range(900, 906))
def test_language_of_one_document(spark, tongues, first):
    """Whether the only document of a label falls to the counts or to the rest, its language is learned."""
    some = tongues.where("doc_id < 30").union(spark.createDataFrame([(first, "こんにちは世界 " * 20, "jj"), (first + 100, "123", "kk")], tongues.schema))
    model = language_id.fit(some, train_docs=200)
    assert model.languages == [*sorted(TONGUES), "jj"]


class PlainKneserNey:
    """Interpolated Kneser-Ney by dictionaries, from padded text of one language."""

    def __init__(self, grams, alphabet):
        self.alphabet, self.levels = alphabet, [Counter(grams)]
        for _ in range(3):
            self.levels.insert(0, Counter(g[1:] for g in self.levels[0]))
        self.discounts = []
        for level in self.levels:
            once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
            self.discounts.append(min(max(once / max(once + 2 * twice, 1), 0.1), 0.9))

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (self.alphabet + 1)
        level, d, below = self.levels[k - 1], self.discounts[k - 1], self.p(gram[1:])
        under = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
        if not under:
            return below
        total = sum(under.values())
        return max(level[gram] - d, 0) / total + d * len(under) / total * below


def test_kneser_ney_is_the_plain_one():
    """Two languages in one table: every symbol's cost, known or not; and the chances of all symbols add up to one."""
    import pandas as pd

    def grams(text):
        padded = "   " + text + " "
        return Counter(padded[i : i + 4] for i in range(len(padded) - 3))

    texts = {"x": "abracadabra banana bandana", "y": "cadenza banal canal papaya"}
    rows = [(lang, g, n) for lang, text in texts.items() for g, n in grams(text).items()]
    tables = language_id.estimate(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    letters = sorted({g[-1] for _, g, _ in rows})
    plain = {lang: PlainKneserNey(grams(text), len(letters)) for lang, text in texts.items()}
    model = language_id.Model([tables], np.full((2, language_id.LEVELS), np.inf))
    for text in [*texts.values(), "banana zebra", "qqq", "a"]:
        h, n, _ = language_id.cross_entropies(model, [text])
        padded = "   " + text + " "
        for j, lang in enumerate(sorted(texts)):
            want = -np.mean([np.log(plain[lang].p(padded[i : i + 4])) for i in range(len(padded) - 3)])
            assert n[0] == len(text) + 1 and abs(h[0, j] - want) < 1e-5
    for context in ("ban", "adz", "zzz", "   "):
        found = np.array([ord(c) for c in "".join(context + c for c in [*letters, "~"])], np.uint32)
        p = np.exp(language_id.log_probabilities(tables, found)[3::4].astype(float))
        assert np.allclose(p.sum(0), 1, atol=1e-5)  # ~ stands for all that was never seen


def test_limits_are_measured(spark, tongues):
    """About as many stretches are rejected as the limits were measured to reject; longer texts have narrower limits."""
    model = language_id.fit(tongues, train_docs=200)
    assert np.isfinite(model.limits).all() and (np.diff(model.limits, axis=1) <= 0.5).all() and (model.limits[:, -1] < model.limits[:, 0]).all()
    fresh = spark.createDataFrame([(i, prose(lang, 9000 + i, 60)) for i, lang in enumerate(list(TONGUES) * 100)], "doc_id long, text string")
    assert language_id.identify(fresh, model).where("rejected").count() <= 2
    other = spark.createDataFrame([(1, "こんにちは世界" * 3), (2, "Ж щ ы э ю я ъ " * 6), (3, "qxqz jjkw vvpf xzzq kwkw")], "doc_id long, text string")
    assert language_id.identify(other, model).where("rejected").count() == 3


def test_labelled_texts_without_letters(spark):
    rows = [(i, ["", " ", "12 34", prose("aa", i)][i % 4], "aa") for i in range(200)] + [(1000 + i, "", "bb") for i in range(20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa"] and np.isfinite(model.limits[0, 0])


def test_more_languages_than_one_table_holds(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TOGETHER", 2)
    docs = spark.createDataFrame([(i, prose(lang, i), lang) for i, lang in enumerate(list(TONGUES) * 60)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, train_docs=100)
    assert [t.languages for t in model.tables] == [["aa", "bb"], ["cc"]]
    assert language_id.identify(docs, model).where("lang = lang_pred and not rejected").count() >= 178


def test_language_without_training(nothing, awkward):
    model = language_id.fit(nothing.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.identify(awkward, model).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def scored_docs(spark):
    draw = random.Random(9)

    def text(i):
        good = words(i, 120)
        return (i, good if i % 4 else " | ".join(w.upper() + draw.choice(["!!", "$$$", ""]) for w in good.split()))

    return spark.createDataFrame([text(i) for i in range(800)], "doc_id long, text string")


def test_quality_held_out(spark, awkward, nothing, rows):
    docs = scored_docs(spark)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400)] + [(9999, None), (None, 1)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs.where("doc_id >= 400"), model).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in got]) > 0.97 and abs(model.prior - 0.75) < 0.1
    odd = quality.score_quality(awkward, model).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert len({r.score for r in odd if not r.text}) == 1  # ties: equal texts score alike
    assert quality.fit(nothing, labels) is None and quality.score_quality(awkward, None).first().score == 0.5


def test_quality_judges_content(spark):
    """Texts of the same form whose letters are replaced, or that are written backwards, are no positives."""
    docs = scored_docs(spark)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600)], "doc_id long, label int")
    model, draw = quality.fit(docs, labels), random.Random(7)
    good = [r.text for r in docs.where("doc_id >= 600 and doc_id % 4 > 0").collect()]
    other = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in t) for t in good]
    share = lambda texts: np.mean(model.score(quality.features(texts, model.content)) >= 0.7)
    assert share(good) > 0.9 and share(other) < 0.2 and share([t[::-1] for t in good]) < 0.2


def test_hashed_content(spark):
    """Words and n-grams of whole texts, none across texts, and their counts over all texts."""
    texts = ["", "ab", "one two  one", "été\tété x", "abcd", " lead", "tail ", "long" * 30 + " " + "long" * 30]
    (row, word), (gram_row, gram) = quality.hashed(texts)
    assert [(row == i).sum() for i in range(len(texts))] == [len(t.split()) for t in texts]
    assert [(gram_row == i).sum() for i in range(len(texts))] == [max(len(t.encode()) - quality.GRAM + 1, 0) for t in texts]
    assert word[row == 2][0] == word[row == 2][2] != word[row == 2][1] and word[row == 7][0] == word[row == 7][1]
    for i, t in enumerate(texts):
        (_, alone), (_, grams) = quality.hashed([t])
        assert np.array_equal(alone, word[row == i]) and np.array_equal(grams, gram[gram_row == i])
    found = quality.counted(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    assert np.array_equal(found[: quality.WORDS], np.bincount(word, minlength=quality.WORDS)) and np.array_equal(found[quality.WORDS : quality.WORDS + quality.GRAMS], np.bincount(gram, minlength=quality.GRAMS))
    assert found[-1] == sum(len(t) + 1 for t in texts)


def test_no_negative_label_is_used(spark):
    docs = scored_docs(spark)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400)], "doc_id long, label int")
    both, ones = quality.fit(docs, labels), quality.fit(docs, labels.where("label = 1"))
    assert np.allclose(both.weights, ones.weights, rtol=1e-6) and abs(both.shift - ones.shift) < 1e-6 and both.prior == ones.prior


def test_sums_over_all_texts_are_the_plain_ones(spark):
    docs = scored_docs(spark)
    x = quality.features([r.text for r in docs.collect()])
    assert np.allclose(quality.products(docs.select("text").repartition(7)), x.T @ x)
    w = np.random.default_rng(2).normal(0, 0.3, (3, quality.FEATURES))
    want = np.stack([np.bincount(quality.binned(x @ v), minlength=quality.BINS) for v in w])
    assert np.abs(quality.margin_counts(docs.select("text").repartition(7), w) - want).sum() <= 2  # a margin on a bin's edge may round


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.9])
def test_risk_is_least(prior):
    """No small step from the weights lowers the risk, whether or not its second part is held at zero."""
    draw = np.random.default_rng(1)
    with_one = lambda x: np.concatenate([x, np.ones((len(x), 1))], 1)
    p = with_one(draw.normal(1, 1, (300, 3)))
    u = with_one(np.concatenate([draw.normal(1, 1, (300, 3)), draw.normal(-1, 1, (700, 3))]))
    sp, su = p.T @ p / len(p), u.T @ u / len(u)

    def risk(w):
        return prior * np.mean((1 - p @ w) ** 2) / 4 + max(0.0, quality.negative_risk(w, su, sp, prior)) + 0.01 / 2 * (w[:-1] ** 2).sum()

    w = quality.minimise_risk(sp, su, prior, 0.01)
    assert all(risk(w + draw.normal(0, scale, 4)) >= risk(w) - 1e-9 for scale in (1e-3, 1e-2, 0.1, 1) for _ in range(200))
    assert abs(quality.negative_risk(w, su, sp, prior) - (np.mean((1 + u @ w) ** 2) - prior * np.mean((1 + p @ w) ** 2)) / 4) < 1e-9


def test_prior_of_a_mixture():
    draw = np.random.default_rng(3)
    of = lambda x: np.bincount(quality.binned(x), minlength=quality.BINS)
    for prior in (0.2, 0.6, 0.9):
        u = np.concatenate([draw.normal(1, 0.3, int(prior * 100_000)), draw.normal(-1, 0.3, int((1 - prior) * 100_000))])
        assert abs(quality.estimate_prior(of(draw.normal(1, 0.3, 2000)), of(u)) - prior) < 0.08
        slope, shift = quality.calibrate(of(draw.normal(1, 0.3, 2000)), of(u), prior)
        assert slope > 2 and abs(shift / slope) < 0.5


def test_audio_round_trip(awkward, nothing, rows):
    stored = mpeg_audio.store_as_audio(awkward)
    got = mpeg_audio.read_audio(stored).collect()
    assert Counter((r.doc_id, bytes(r.audio.payload)) for r in got) == Counter((i, mpeg_audio.padded((t or "").encode())) for i, t in rows)
    for r in got:
        a = r.audio
        assert a.damaged == 0 and a.skipped == 0 and a.sound == a.frames + 1 and a.table_frames == a.frames == len(a.offsets)
        assert a.seconds == a.frames * 1152 / 32000 and a.tags["payload_bytes"] == str(len(a.payload))
        assert all(bytes(r.media)[o] == 0xFF for o in a.offsets)
    assert mpeg_audio.read_audio(mpeg_audio.store_as_audio(nothing)).count() == 0


def test_audio_resynchronises():
    whole = mpeg_audio.write_stream(mpeg_audio.padded(b"some text " * 500))
    read = mpeg_audio.read_stream
    clean = read(whole)
    at = clean.offsets[2]
    noisy = read(whole[:at] + b"\xff\x00noise\xff\xfb" + whole[at:])
    assert noisy.payload == clean.payload and noisy.skipped == 9 and noisy.frames == clean.frames
    broken = bytearray(whole)
    broken[at + 10] ^= 1
    assert read(bytes(broken)).damaged == 1
    cut = read(whole[:-30])
    assert cut.frames == clean.frames - 1 and cut.skipped > 0
    assert read(None).frames == read(b"").frames == read(b"no audio here").frames == 0
    tagged = read(whole + b"TAG" + b"A title".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["TIT2"] == "A title" and tagged.frames == clean.frames


def test_audio_headers():
    layer2 = mpeg_audio.frame_of(bytes((0xFF, 0xFD, 0x80, 0x00)))
    assert (layer2.layer, layer2.kbps, layer2.rate, layer2.samples, layer2.size) == (2, 128, 44100, 1152, 417)
    half = mpeg_audio.frame_of(bytes((0xFF, 0xF3, 0x40, 0xC0)))
    assert (half.version, half.layer, half.kbps, half.rate, half.samples) == (2.0, 3, 32, 22050, 576)
    assert mpeg_audio.frame_of(b"\xff\xff\xff\xff") is None
    head = bytes((0xFF, 0xFB, 0x90, 0x00))
    vbri = head + bytes(32) + b"VBRI" + bytes(6) + struct.pack(">IIH", 834, 1, 3)
    frame = vbri.ljust(417, b"\0")
    found = mpeg_audio.read_stream(frame + head + bytes(413))
    assert (found.table.bytes, found.table.frames, found.frames) == (834, 1, 1)


def test_audio_seek_tables():
    """Points of both kinds of table as offsets in bytes; the writer's lead to the frames that they stand for."""
    read = mpeg_audio.read_stream(mpeg_audio.write_stream(bytes(range(256)) * 800))
    start = read.offsets[0] - mpeg_audio.lead_of(next(g for g in range(1, 15) if mpeg_audio.lead_of(g)[1] - mpeg_audio.LEAD >= 120))[1]
    assert len(read.table.seek) == 100 and read.table.frames == read.frames
    for percent, point in enumerate(read.table.seek):
        wanted = read.offsets[percent * read.frames // 100] - start
        assert point <= wanted < point + -(-read.table.bytes // 256)
    head = bytes((0xFF, 0xFB, 0x90, 0x00))
    vbri = head + bytes(32) + b"VBRI" + bytes(6) + struct.pack(">IIHHHH", 834, 2, 3, 10, 2, 1) + struct.pack(">HHH", 41, 42, 5)
    table = mpeg_audio.read_stream(vbri.ljust(417, b"\0") + head + bytes(413)).table
    assert (table.frames, table.bytes, table.seek) == (2, 834, [410, 830, 880])


def plain_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)
    return crc


@pytest.mark.parametrize("layer, mode, bound", [(1, 0x00, 32), (1, 0x40, 4), (1, 0xC0, 32), (2, 0x00, 32), (2, 0x50, 8), (2, 0xC0, 32)])
def test_audio_checksums_of_layers_one_and_two(layer, mode, bound):
    """Allocations by plain bit strings: layer I 4 bits for each of 32 subbands; layer II, 192 kbit/s, 30 subbands."""
    draw = random.Random(layer * 1000 + mode)
    head = bytes((0xFF, 0xFE if layer == 1 else 0xFC, (6 if layer == 1 else 10) << 4, mode))
    frame = mpeg_audio.frame_of(head)
    widths = [4] * 32 if layer == 1 else [4] * 11 + [3] * 12 + [2] * 7
    channels, bits, scale = 1 if frame.mono else 2, "", 0
    for subband, width in enumerate(widths):
        alone = frame.mono or subband >= bound
        for _ in range(1 if alone else 2):
            value = draw.randrange(1 << width) * draw.randrange(2)
            bits += f"{value:0{width}b}"
            scale += (value > 0) * (channels if alone else 1)
    if layer == 2:
        bits += "".join(draw.choice("01") for _ in range(2 * scale))
    want = plain_crc(f"{int.from_bytes(head[2:], 'big'):016b}" + bits)
    body = bits + "".join(draw.choice("01") for _ in range((frame.size - 6) * 8 - len(bits)))
    packed = int(body, 2).to_bytes(frame.size - 6, "big")
    good, bad = (head + struct.pack(">H", crc) + packed for crc in (want, want ^ 1))
    assert (mpeg_audio.read_stream(good + good).sound, mpeg_audio.read_stream(good + bad).damaged) == (2, 1)


def test_byte_bpe(awkward, nothing, rows):
    encoding = load(RANKS, public_tokenizers.PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    coded = bpe_encode(awkward, RANKS, public_tokenizers.PATTERN)
    got = bpe_decode(coded, RANKS).collect()
    want = Counter((i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe_encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_in_small_chunks(awkward, rows, monkeypatch):
    from tallybook.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "CHUNK_WORDS", 50)
    encoding = load(RANKS, public_tokenizers.PATTERN)
    got = bpe_encode(awkward, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(encoding.encode_ordinary(t or ""))) for i, t in rows)


def test_columns_of_any_name_come_back(awkward):
    """Extra columns named after what operators use inside, in either letter case, come back unchanged."""
    from tallybook.llm.exact_dedup import drop_exact_copies
    from tallybook.llm.minhash import drop_near_copies

    model = language_id.Model()
    made = {
        ("base", "spans"): scan_secrets(awkward), (): redact_secrets(awkward), ("score", "predicted"): quality.score_quality(awkward, None),
        ("lang_pred", "score", "cross_entropy", "rejected"): language_id.identify(awkward, model), ("exact",): drop_exact_copies(awkward), ("near",): drop_near_copies(awkward),
        ("audio",): mpeg_audio.read_audio(awkward.withColumn("media", F.lit(b"x"))), ("decoded",): bpe_decode(awkward.withColumn("ids", F.array(F.lit(1))), RANKS),
    }
    for added, out in made.items():
        extra = [c for c in awkward.columns if c not in ("doc_id", "text", "lang", "media", "ids") and c.lower() not in added]
        assert [c for c in out.columns if c in extra] == extra
        assert all(r[c] == "x" for r in out.select(*(f"`{c}`" for c in extra)).collect() for c in extra)


def test_empty_tables(nothing):
    assert scan_secrets(nothing).count() == redact_secrets(nothing).count() == 0
    assert packing.pack_documents(nothing, WORD_BPE).count() == 0
