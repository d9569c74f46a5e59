"""URL templates, toxicity, search, archive and packing against plain Python and round trips."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardstream.llm import deobfuscate, maxscore, packing, url_templates, warc_archive
from wardstream.llm.queries import tokenizer_path

# -- URL templates ----------------------------------------------------------------------------


def located(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_are_parsed_and_ruled(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://É.Org/x?y#z", "x://a.com/de/1?/fr/", "http://a.com#/de/", "http://acom/fr/",
            "http://example.org/en/12", "http://m.example.org/es/", "http://b.com/fr/a/b/c/d/e/f/g/h", "http://h.net?x://q/y", "http://h.net/a\n/b"]
    urls += [f"http://s.net/u/{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)] + [(4, urls[4], "p")], "page_id long, url string, path string")
    got = sorted(url_templates.judge(docs).collect(), key=lambda r: r.page_id)
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = located(urls[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert {r.template for r in got if r.host == "s.net"} == {"/u/*"}
    assert url_templates.judge(docs.limit(0)).count() == 0


def test_bad_branch_is_rejected_and_good_one_kept(spark):
    rng = random.Random(1)
    urls = [f"http://h.net/{'spam' if i % 3 == 0 else rng.choice(['news', 'wiki'])}/{i}.html" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("spam" in u)) for i, u in enumerate(urls) if i % 2], "page_id long, bad int")
    got = url_templates.judge(docs, rules=[], labels=labels).collect()
    assert all((r.verdict == "block") == ("spam" in r.path) for r in got)
    assert {r.template for r in got} == {"/spam/*.html", "/news/*.html", "/wiki/*.html"}


def test_tree_smooths_merges_and_goes_to_the_end(spark):
    """(url, label or None): an unlabelled branch follows its host, inner branches merge, deep paths are told apart."""
    rows = [(f"http://bad.net/{b}/page", 1) for b in ("a", "b", "c") for _ in range(10)] + [("http://bad.net/d/page", None)]
    rows += [(f"http://good.net/{b}/page", 0) for b in ("a", "b", "c") for _ in range(40)]
    deep = "http://deep.net/a/b/c/d/e/f/"
    rows += [(f"{deep}{b}", int(b == "bad")) for b in ("bad", "good") for _ in range(20)]
    # /news and /wiki are one branch, so /wiki/x is judged with the labels of /news/x; /shop is another branch
    rows += [("http://two.net/news/x", 1)] * 30 + [("http://two.net/news/y", 0)] * 30 + [("http://two.net/wiki/x", 1), ("http://two.net/wiki/y", 0)]
    rows += [("http://two.net/shop/x", 0)] * 60
    docs = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows) if b is not None], "page_id long, bad int")
    got = {(r.host, r.path): r for r in url_templates.judge(docs, rules=[], labels=labels).collect()}
    assert got["bad.net", "/d/page"].verdict == "block" and got["good.net", "/a/page"].verdict == "allow"
    assert got["deep.net", "/a/b/c/d/e/f/bad"].verdict == "block" and got["deep.net", "/a/b/c/d/e/f/good"].verdict == "allow"
    assert got["two.net", "/news/x"].rate == pytest.approx(got["two.net", "/wiki/x"].rate, abs=0.01) and got["two.net", "/wiki/x"].verdict == "block"
    assert got["two.net", "/wiki/y"].verdict == got["two.net", "/shop/x"].verdict == "allow"


# -- toxicity ---------------------------------------------------------------------------------


def english_model():
    words = "the stupid idiot clown is a pathetic loser and this that with other words ordinary sentence trash moron garden".split()
    grams: dict[str, int] = {}
    for w in words * 30:
        marked = f"^^{w}$"
        for i in range(len(marked) - 2):
            grams[marked[i:i + 3]] = grams.get(marked[i:i + 3], 0) + 1
    return deobfuscate.CharacterModel(grams)


@pytest.mark.parametrize(("written", "meant"), [
    ("1d10t", "idiot"), ("st*u*p*i*d", "stupid"), ("stuuuuupid", "stupid"), ("$tup1d", "stupid"), ("l0ser!!", "loser"), ("cl.o.wn", "clown"),
    ("garden,", "garden"), ("the&&&", "the"), ("m0r0n", "moron")])
def test_viterbi_restores_words(written, meant):
    assert deobfuscate.restore_word(written, english_model()) == meant


def test_spaced_letters_are_one_word():
    model = english_model()
    assert "idiot" in deobfuscate.Restorer(model).words("you i d i o t there")
    assert deobfuscate.restored_text("an I.D.I.O.T here", model) == "an idiot here"


@pytest.mark.parametrize(("written", "meant"), [
    ("stu" + "u" * 60 + "pid", "stupid"), ("!diot", "idiot"), ("<lown", "clown"), ("|d|o+", "idiot"), ("@$$", "ass"), ("455", "ass"), ("(garden)", "garden"),
    ("garden!", "garden"), ("1d1o7!", "idiot")])
def test_the_whole_channel_reaches_the_lattice(written, meant):
    words = {"stupid": 30, "idiot": 30, "clown": 100, "ass": 200, "garden": 30, "loser": 30, "ordinary": 30}
    marked = [(f"^^{w}$", n) for w, n in words.items()]
    grams = Counter()
    for w, n in marked:
        for i in range(len(w) - 2):
            grams[w[i:i + 3]] += n
    assert deobfuscate.restore_word(written, deobfuscate.CharacterModel(grams)) == meant


def test_spaced_runs_are_parted_into_words():
    model = english_model()
    words = deobfuscate.Restorer(model).words("you s t u p i d i d i o t and a $ t u p 1 d")
    assert {"stupid", "idiot"} <= words
    assert deobfuscate.restored_text("a s t u p i d", model) == "a stupid"
    assert deobfuscate.restored_text("such s t u p i d i d i o t here", model) == "such stupid idiot here"


def test_no_state_is_dropped_and_long_tokens_are_read():
    """The best path against a table of all states, where more than 24 are alive."""
    model, token = english_model(), "6!1|8+9(0$@3" * 4
    best = {"^^": (0.0, "")}
    for ways in deobfuscate.readings(token):
        paths = [(cost + own + (model.cost(s, c) if c else 0.0), t + c, s[1] + c if c else s) for s, (cost, t) in best.items() for c, own in ways]
        best = {s: min((n, t) for n, t, to in paths if to == s) for s in {p[2] for p in paths}}
    assert len(best) > 24
    want = min(cost + model.cost(s, "$") for s, (cost, _) in best.items())
    got = deobfuscate.decode(token, model)
    assert min(cost + model.cost(s, "$") for s, (cost, t) in best.items() if t == got) == pytest.approx(want)
    assert deobfuscate.restore_word("i" + "d10t" * 20_000, model)


def test_decode_is_the_best_path():
    """Viterbi against all readings of short tokens."""
    model = english_model()

    def best(token):
        ways = [("", "^^", 0.0)]
        for options in deobfuscate.readings(token):
            ways = [(t + c, (s[1] + c) if c else s, n + own + (model.cost(s, c) if c else 0.0)) for t, s, n in ways for c, own in options]
        return min((n + model.cost(s, "$"), t) for t, s, n in ways)[1]

    for token in ("1d10t", "a$$", "l0$3r", "tr4sh", "m()ron", "1!1"):
        assert deobfuscate.decode(token, model) == best(token)


def test_scores_learn_and_hold_out(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "me") for b in ("ran", "tos", "min", "pel", "dor")]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(30)]
        if toxic:
            text[7] = rng.choice(["vermin", "v3rmin", "verrrrmin", "v.e.r.m.i.n"])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, None, "x"), (901, "", "x"), (902, "vermin " * 5000, "x"), (1, rows[1][1], "en")],
                                 "doc_id long, text string, score string")
    told = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = deobfuscate.score(docs, *deobfuscate.fit(docs, told)).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    by = {r.doc_id: r.predicted for r in got}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([by[i] == int(i % 5 == 0) for i in held]) > 0.95
    assert (by[900], by[901], by[902]) == (0, 0, 1)
    blank = deobfuscate.score(docs, *deobfuscate.fit(docs, told.limit(0)))
    assert blank.filter("predicted = 1").count() == 0
    assert deobfuscate.score(docs.limit(0), *deobfuscate.fit(docs.limit(0), told)).count() == 0


# -- search -----------------------------------------------------------------------------------


def test_search_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 12)], "l") for i in range(400)]
    rows += [(1000 + i, rows[3][1], "l") for i in range(30)]  # ties
    rows += [(2000, None, "l"), (2001, [1.0, None], "l"), (2002, [float("nan")] * 12, "l"), (2003, [float("inf")] * 12, "l"), (5, rows[5][1], "l")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = maxscore.search(vectors, F.col("vec_id") % 20 == 0, candidates=90, queries=7).collect()
    good = [(i, np.floor(np.float32(v).astype(float) * 256).astype(int)) for i, v, _ in rows if i < 2000]
    want = []
    for q, v in {i: v for i, v in good if i % 20 == 0}.items():
        best = sorted((-int(v @ x), i) for i, x in good if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_prunes_and_small_tables(spark):
    rng = np.random.default_rng(7)
    shard = np.round(rng.normal(0, 40, (5000, 32)))
    query = np.append(np.full(4, 300.0), np.full(28, 3.0))
    at, scores, full = maxscore.best_in_shard(query, shard, np.arange(5000), -1, 5, shard.min(axis=0), shard.max(axis=0))
    assert sorted(scores, reverse=True) == sorted(shard @ query)[::-1][:5] and full < 2500 and len(at) == 5
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in maxscore.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert maxscore.search(few.limit(0), F.col("vec_id") == 0).count() == 0


# -- archive ----------------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    long_html = "<p>é</p>" * 200
    rows = [(1, "http://a/", "short"), (2, "http://b/", "short"), (3, "http://c/ x\r\nEvil: 1", long_html), (9, None, long_html), (7, "http://d/", long_html),
            (4, "u", None), (5, "u", ""), (None, "u", long_html), (9, "again", long_html)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    path = str(tmp_path / "archive")
    warc_archive.write_archive(pages, path)
    got = sorted(map(tuple, warc_archive.verify(spark, path).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        visit = len(data) >= 1000 and i != 9
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", 9 if visit else None))
    assert got == sorted(want, key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in warc_archive.rebuild(spark, path).filter("page_id IS NOT NULL").collect():
        record = bytes(r.record)
        head, body = record.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nEvil" not in head and body.endswith(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert length == len(body) - 4
        html = next(h for i, _, h in rows if i == r.page_id)
        assert bytes(r.payload) == (html or "").encode() and (length == 0 or body[:-4] == bytes(r.payload))


def test_a_record_of_another_length_fails(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "short"), (2, "http://b/", "longer")], "page_id long, url string, html string")
    path, bent = str(tmp_path / "a"), str(tmp_path / "bent")
    warc_archive.write_archive(pages, path)
    headers, stored = warc_archive.read_archive(spark, path)
    stored.write.parquet(f"{bent}/payloads")
    text = F.regexp_replace(F.decode("header", "UTF-8"), "Content-Length: 5", "Content-Length: 4")
    headers.withColumn("header", F.encode(text, "UTF-8")).write.parquet(f"{bent}/headers")
    with pytest.raises(Exception, match="does not match"):
        warc_archive.verify(spark, bent).collect()


def test_archive_of_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc_archive.write_archive(pages, str(tmp_path / "a"))
    assert warc_archive.verify(spark, str(tmp_path / "a")).count() == 0


# -- packing ----------------------------------------------------------------------------------


def best_fit(lengths, limit):
    """Best-fit decreasing over single pieces: the number of sequences."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else limit) - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used: dict[int, list[tuple[int, int]]] = {}
    for length, low, high, first, each, offset in packing.plan_best_fit(counts, 30):
        for r in range(low, high):
            used.setdefault(first + (r - low) // each, []).append((offset + (r - low) % each * length, length))
    assert sorted(n for s in used.values() for _, n in s) == sorted(lengths)
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 30
    assert len(used) == best_fit(lengths, 30)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'sé\u0301 \n\t\x0b\x1c\x1f\u00a0\u2003\u0085<|endoftext|>12!?日Ω\u03a3"), max_size=60))
def test_word_tokens_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.WordEncoder(tokenizer_path())(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_pack_round_trip(spark):
    rng = random.Random(8)
    texts = [None, "", "same text"] + ["same text"] * 20 + [" ".join(rng.choice(["alpha", "beta7", "gamma!", "ö"]) for _ in range(rng.randrange(90))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, length int")
    packed = packing.pack(docs, tokenizer_path(), limit=32, keep_ids=True).cache()
    encode = packing.WordEncoder(tokenizer_path())
    by: dict[int, dict] = {}
    for r in packed.collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length <= 32 and r.start == 32 * r.piece
        if r.doc_id != 3:
            by.setdefault(r.doc_id, {})[r.piece] = bytes(r.ids)
    for i, t in enumerate(texts):
        if i != 3:
            assert b"".join(p for _, p in sorted(by[i].items())) == encode(t or "") + bytes(4)
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.length <= 128 for r in whole)
    for _, slots in packed.toPandas().groupby("sequence_id"):
        slots = slots.sort_values("offset")
        assert slots["offset"].tolist() == [0, *slots["length"].cumsum()[:-1].tolist()]
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
