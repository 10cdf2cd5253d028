import base64
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import zstandard
from corpus_texts import prose
from pyspark.sql import functions as F

from gridloom.llm import quality_classifier, quality_rules, url_filter
from gridloom.llm.quality_rules import Bands

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_bands(raw, bands=Bands()):
    """The bands written out again: the whole by its length; chunks from 4096 bytes on, the last one up to the end."""
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)

    def ratio(part):
        return len(pack.compress(part)) / max(1, len(part))

    low, high = [x[1:] for x in bands.whole if len(raw) >= x[0]][-1]
    limits = bands.chunk if len(raw) >= 8192 else (low, high)
    chunks = [raw[i : i + 4096] for i in range(0, len(raw) - 4095, 4096)] + ([raw[-4096:]] if len(raw) >= 4096 else [])
    return low <= ratio(raw) <= high and all(limits[0] <= ratio(c) <= limits[1] for c in chunks)


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    hit = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    kept = not failed and in_bands(text.encode())
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed, kept)


def test_rules_equal_brute_force(frame, odd_texts):
    block = prose(1, 30)
    texts = odd_texts + [block + " | " + block, "line one\nline one\n \nline two\nline one " + prose(2, 20), "a b c d e a b c d e f", prose(3, 400), "### $$$ " * 30, "\u00a0x\u2003y \x1cz " + prose(4, 9)]
    got = {r.doc_id: tuple(r)[1:8] for r in quality_rules.judge(frame(texts).withColumnRenamed("lang", "kept")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_filter_keeps_columns_and_rows(frame, odd_texts):
    texts = odd_texts + [prose(i, 300) for i in range(6)] * 2
    df = frame(texts).withColumnRenamed("lang", "ratio")
    out = quality_rules.filter_documents(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, t in enumerate(texts) if plain(t)[6]]
    assert quality_rules.filter_documents(frame([])).count() == 0


def test_repetition_and_noise_fail():
    import random

    r, pack = random.Random(1), zstandard.ZstdCompressor(level=3)
    assert quality_rules.verdict(prose(1, 900).encode(), Bands(), pack)[0] in (True, False)
    assert not quality_rules.verdict(("same words again and again " * 400).encode(), Bands(), pack)[0]
    assert not quality_rules.verdict(bytes(r.randrange(33, 127) for _ in range(9000)), Bands(), pack)[0]


def test_votes_equal_a_sort_of_all_cosines():
    r = np.random.default_rng(3)
    v = quality_classifier.Voting(rank=6, neighbours=7, block=16)
    x, labels = r.random((90, 40)).astype(np.float32), (r.random(90) < 0.4).astype(float)
    space, asked = quality_classifier.Space(x, labels, v), r.random((25, 40)).astype(np.float32)
    cosines = space.project(asked).astype(float) @ space.known.astype(float).T
    for i, got in enumerate(space.score(asked, v)):
        near = sorted(range(90), key=lambda j: -cosines[i, j])[:7]
        weights = [math.exp(v.sharpness * (cosines[i, j] - cosines[i, near[0]])) for j in near]
        assert got == pytest.approx(sum(w * labels[j] for w, j in zip(weights, near, strict=True)) / sum(weights), abs=1e-4)


def test_classifier_votes(spark, frame, odd_texts):
    texts = [prose(i, 80) for i in range(120)] + [prose(i, 80).replace(" ", "*** ").upper() for i in range(120)]
    df = frame(texts + odd_texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(None, 1, 0), (3, None, 0), (999999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.judge(df.withColumnRenamed("lang", "score"), labels).collect()}
    assert len(got) == len(texts) + len(odd_texts)
    import zlib

    for i in range(240):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [got[i] for i in range(240) if got[i].held_out]
    assert sum((r.score >= 0.7) == (r.doc_id < 120) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_classifier_without_labels(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_classifier.judge(frame(["a", None]), labels).collect()] == [0.5, 0.5]
    assert quality_classifier.filter_documents(frame([]), labels).count() == 0


def test_held_out_labels_change_nothing(spark, frame):
    df = frame([prose(i, 40) for i in range(60)])
    a = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    b = a.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["x"]).when(quality_classifier.held_out(a.doc_id), 1 - a.quality).otherwise(a.quality))
    assert sorted(map(tuple, quality_classifier.judge(df, a).collect())) == sorted(map(tuple, quality_classifier.judge(df, b).collect()))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule(host, path):
    best = None
    for text, verdict in url_filter.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return best or (None, None)


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.NET/x", "https://example.net/en/1?x", "http://example.net/en", "http://net/", "http://net", "http://xnet/", "ftp://www.example.com/de/", "http://example.com:80/de/x", "http://a.org/fr/b#c", "http://a.org/frx", "x://y://z.org/fr/", "http://É.net/a\nb", "http://h?x/y", "http://a.org/fr/"]
    pages = spark.createDataFrame([(i, u, "<p>", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(urls):
        host, path = split(u)
        text, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, text)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert got[0].verdict == "allow" and url_filter.judge(pages.limit(0)).count() == 0


def test_url_models_tell_hosts_apart(spark):
    good = [(i, f"http://lib{i % 9}.example.org/fr/book{i}") for i in range(200)]
    bad = [(200 + i, f"http://casino-win{i % 9}.net/bonus{i}") for i in range(200)]
    asked = [(900, "http://lib4.example.info/fr/book7"), (901, "http://casino-win3.biz/bonus5")]
    pages = spark.createDataFrame(good + bad + asked, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert got[900].verdict == "allow" and got[901].verdict == "block" and got[900].score > got[901].score


class PlainModel:
    """Witten-Bell over dictionaries, character by character."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for t in texts:
            for context, c in self.steps(t):
                for k in range(order + 1):
                    here = self.seen.setdefault(context[len(context) - k :], Counter())
                    here[c] += 1

    def steps(self, text):
        s = [257] * self.order + list(text.encode()) + [256]
        return [(tuple(s[i - self.order : i]), s[i]) for i in range(self.order, len(s))]

    def log(self, text):
        out = []
        for context, c in self.steps(text):
            p = 1 / 258
            for k in range(self.order + 1):
                here = self.seen.get(context[len(context) - k :])
                if here:
                    p = (here[c] + len(here) * p) / (sum(here.values()) + len(here))
            out.append(math.log(p))
        return sum(out) / len(out)


@pytest.mark.parametrize("chunk", [7, 1 << 14])
def test_scores_equal_brute_force(spark, chunk):
    """Scores of all URLs without a rule against plain dictionaries, and the share of held-back URLs judged rightly."""
    r = random.Random(8)
    slug = lambda: "".join(r.choice("abcdeé-/%7") for _ in range(r.randint(0, 12)))
    urls = [f"https://{r.choice(('lib', 'med', 'x'))}{r.randrange(9)}.{r.choice(('org', 'net', 'com', 'info'))}/{r.choice(('fr', 'en', 'de'))}/{slug()}" for _ in range(500)]
    urls += [None, "none", "z://", "a://b\x00c/" + "long/" * 400]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, text string")
    m = url_filter.Markov(chunk=chunk)
    got = {x.page_id: x for x in url_filter.judge(pages, m=m).collect()}
    held = {x.page_id for x in pages.filter(F.pmod(F.xxhash64("url"), F.lit(m.hold)) == 0).collect()}
    text = {i: "".join(split(u)) for i, u in enumerate(urls)}
    decided = {i: rule(*split(u))[1] for i, u in enumerate(urls)}
    models = [PlainModel([text[i] for i in text if decided[i] == c and i not in held], m.order) for c in ("allow", "block")]
    asked = [i for i in text if not decided[i] and text[i]]
    assert len(got) == len(urls) and len(asked) > 100 and all(got[i].score is None for i in text if decided[i])
    want = {i: models[0].log(text[i]) - models[1].log(text[i]) for i in text}
    assert all(got[i].score == pytest.approx(want[i], abs=1e-9) for i in asked)
    assert all((got[i].score, got[i].verdict) == (0.0, "allow") for i in (500, 501, 502))
    # the threshold lies between the scores that it allows and those that it blocks, and tells the held-back URLs apart
    allowed, blocked = ([want[i] for i in asked if got[i].verdict == v] for v in ("allow", "block"))
    cut = (min(allowed) + max(blocked)) / 2
    right = [(want[i] >= cut) == (decided[i] == "allow") for i in held if decided[i]]
    assert min(allowed) > max(blocked) and sum(right) >= 0.9 * len(right) and len(right) > 20


def test_noise_at_the_end_fails_as_at_the_start():
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    r = random.Random(3)
    for size, extra in ((8000, 4000), (12000, 4000), (3500, 3500)):
        text, noise = english(r, size), base64.b64encode(r.randbytes(extra))[:extra]
        assert quality_rules.verdict(text, Bands(), pack)[0] and quality_rules.verdict(text + english(r, extra), Bands(), pack)[0]
        assert not quality_rules.verdict(noise + b" " + text, Bands(), pack)[0]
        assert not quality_rules.verdict(text + b" " + noise, Bands(), pack)[0]


def english(r, size):
    """Frequent words and rarer ones, which compress about as prose does."""
    often = [prose(i, 1) for i in range(60)]
    return " ".join(r.choice(often) if r.random() < 0.5 else "".join(r.choices("etaoinshrdlucmfwyp", k=6)) for _ in range(size)).encode()[:size].decode(errors="ignore").encode()


def test_packed_rows_give_the_same_space():
    v = quality_classifier.Voting()
    random = np.random.default_rng(3)
    x = (random.random((700, quality_classifier.terms(v))) * (random.random((700, quality_classifier.terms(v))) < 0.05)).astype(np.float16).astype(np.float32)
    x[5] = 0
    rows = quality_classifier.Rows([quality_classifier.pack(r) for r in x], x.shape[1])
    assert np.array_equal(rows[:], x) and np.array_equal(rows[690:900], x[690:])
    labels = (np.arange(700) % 3 == 0).astype(float)
    whole, parts = quality_classifier.Space(x, labels, v, part=1000), quality_classifier.Space(rows, labels, v, part=64)
    assert np.array_equal(whole.weights, parts.weights)
    assert np.allclose(whole.known @ whole.known.T, parts.known @ parts.known.T, atol=1e-2)


def test_learning_keeps_the_driver_small(spark):
    """The rows as a dense matrix would take 40 MB here, and a weighted copy as much again."""
    rows = [(i, " ".join(f"w{(i * k) % 977}" for k in range(1, 60))) for i in range(4000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, quality int")
    tracemalloc.start()
    space = quality_classifier.learn(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(space.labels) > 2900 and peak < 36e6
