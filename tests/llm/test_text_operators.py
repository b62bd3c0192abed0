import hashlib
import itertools
import os
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lexiwave.llm import bpe, licences, line_dedup, quality, secrets
from lexiwave.llm.bytewords import text_buffers

from .helpers import documents, prose, words


def empty(df):
    return df.limit(0)


# op1

def base_counts(t):
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = [any(0 <= j < len(w) - 2 and grams[tuple(w[j : j + 3])] > 1 for j in (i - 2, i - 1, i)) for i in range(len(w))]
    seen, copies = set(), 0
    for x in (t or "").split("\n"):
        if words(x):
            copies += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), copies, sum(covered)


def test_quality(spark):
    docs = documents(spark, ["a b c a b c a b c\n" * 9, "x | y | z\n\nx | y | z\n#$%"])
    for r, t in zip(quality.judge(docs, None).collect(), [r.text for r in docs.collect()]):
        counts = base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and r.kept == (not r.base_failed)
    assert quality.judge(empty(docs), None).count() == 0
    assert quality.learn(docs, spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")) is None


def test_quality_counts_at_random():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\t|é#") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    lines = quality.Lines(*text_buffers(pa.array(texts)))
    got = zip(lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)
    assert [tuple(map(int, g)) for g in got] == [base_counts(t) for t in texts]


def test_field():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, pair = int(rng.integers(1, 7)), rng.normal(size=(2, 2))
        s = rng.normal(size=(n, 2))
        value = lambda y: sum(s[i, y[i]] for i in range(n)) + sum(pair[a, b] for a, b in zip(y, y[1:]))
        assert tuple(quality.LineField(np.zeros((1, 2)), pair).labels(s, np.array([0, n]))) == max(itertools.product((0, 1), repeat=n), key=value)
    for _ in range(20):  # forward-backward against all labellings
        n, pair = int(rng.integers(1, 6)), rng.normal(size=(2, 2))
        s = rng.normal(size=(n + 2, 2, 2))
        live = np.stack([np.arange(n + 2) < n, np.arange(n + 2) < n + 2], axis=1)
        total, one, two = quality.LineField.expected(s * live[:, :, None], live, pair)
        for column, m in ((0, n), (1, n + 2)):
            every = {y: np.exp(sum(s[i, column, y[i]] for i in range(m)) + sum(pair[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=m)}
            z = sum(every.values())
            assert np.isclose(total[column], np.log(z)) and not one[m:, column].any() and not two[max(m - 1, 0) :, column].any()
            assert all(np.isclose(one[i, column, a], sum(v for y, v in every.items() if y[i] == a) / z) for i in range(m) for a in (0, 1))
            assert all(np.isclose(two[i, column, a, b], sum(v for y, v in every.items() if y[i : i + 2] == (a, b)) / z) for i in range(m - 1) for a in (0, 1) for b in (0, 1))
    good = ["\n".join("some plain words of usual length in a line of prose" for _ in range(3))] * 20
    bad = ["\n".join("## $$ || %%%" for _ in range(4))] * 20
    lines = quality.Lines(*text_buffers(pa.array(good + bad)))
    field = quality.LineField.fit(lines.features, lines.first, np.array([1] * 60 + [0] * 80), steps=40)
    labels = field.labels(field.scores(lines.features), lines.first)
    assert labels[:60].all() and not labels[60:].any()
    # lines of a bad text that look like good ones are told from the rest
    half = ["\n".join([good[0].split("\n")[0]] * 2 + ["## $$ || %%%"] * 3)] * 20
    lines = quality.Lines(*text_buffers(pa.array(good + half)))
    marks = quality.line_labels(lines.features, lines.first, np.array([1] * 20 + [0] * 20))
    assert marks.tolist() == [1] * 60 + [1, 1, 0, 0, 0] * 20 or marks[60:].reshape(20, 5)[:, 2:].sum() == 0
    field = quality.LineField.fit(lines.features, lines.first, marks, steps=60)
    assert len(set(field.labels(field.scores(lines.features), lines.first)[60:65].tolist())) == 2


def test_learning_from_tables(spark):
    good, bad = "some plain words of usual length in a line of prose\n" * 3, "## $$ || %%%\n" * 300 + "some plain words of usual length"
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)] + [(None, good), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    field = quality.learn(docs, labels, lines=50)
    shares = {r.id: r.content_share for r in quality.judge(docs.where("text is not null and doc_id is not null"), field).collect()}
    assert all((s > 0.5) == bool(i % 2) for i, s in shares.items())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_quality_of_documents_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = quality.learn(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, field).join(labels.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), "quality"), "id")
    right = {r.quality: r.right for r in rows.groupBy("quality").agg(F.avg((F.col("content_share") >= 0.5).cast("double")).alias("right")).collect()}
    assert right[1] > 0.97 and right[0] < 0.1


# op5

def test_licences(spark):
    docs = documents(spark, ["intro\nReleased under\tthe MIT License!\nend", "x\n\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n\ny", *[w for v in licences.TEMPLATES.values() for w in v]])
    got = licences.scan_licences(docs).collect()
    assert [r.licence for r in got][:12] == [None] * 10 + ["MIT", "GPL-3.0"]
    assert [r.licence for r in got][12:-1] == [n for n, v in licences.TEMPLATES.items() for _ in v]
    assert licences.scan_licences(empty(docs)).count() == 0
    assert licences.scan_licences(docs, templates={}).where("licence is not null").count() == 0


def test_whole_licences_and_several_in_a_text(spark, tmp_path):
    three = licences.TEMPLATES["BSD-3-Clause"][2].replace("met: 1.", "met:\n\n1.").replace("THIS SOFTWARE", "\n\nTHIS SOFTWARE")
    mit = licences.TEMPLATES["MIT"][2].replace("conditions: The", "conditions:\n\nThe").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    texts = [mit, mit.replace("\n", " "), f"{prose(1, 50)}\n{three}\n{prose(2, 50)}\n{mit}", licences.TEMPLATES["LGPL-2.1"][0], licences.TEMPLATES["AGPL-3.0"][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licences.scan_licences(docs).orderBy("id").collect()
    assert [r.licence for r in got] == ["MIT", "MIT", "BSD-3-Clause", "LGPL-2.1", "AGPL-3.0"]
    assert {x.licence: x.dice for x in got[2].licences}["MIT"] == 1.0 and all(r.dice == 1 for r in got)
    (tmp_path / "Own").write_text("one two three four five six\nseven eight nine ten")
    own = licences.read_templates(str(tmp_path))
    found = licences.scan_licences(spark.createDataFrame([(1, "zero One, two three four five six seven eight nine ten eleven")], "doc_id long, text string"), templates=own).first()
    assert (found.licence, found.dice) == ("Own", 1.0)


def test_whole_texts_of_long_licences(spark):
    """The built-in whole texts, without the notice at their end, among prose; a text cut in half is not one of them."""
    whole = {n: w[-1] for n, w in licences.built_in().items() if len(w[-1]) > 5000}
    assert sorted(whole) == ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    texts = [f"{prose(3, 300)}\n\n{w[: int(0.92 * len(w))]}\n\n{prose(4, 300)}" for w in whole.values()] + [w[: len(w) // 2] for w in whole.values()]
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("id").collect()
    assert [r.licence for r in got] == [*whole, *[None] * 6] and all(r.dice > 0.9 for r in got[:6])


def test_licences_across_paragraphs_and_neighbours(spark):
    apache, gpl, bsd = licences.TEMPLATES["Apache-2.0"][1], licences.TEMPLATES["GPL-3.0"][1], licences.TEMPLATES["BSD-2-Clause"][1]
    apache = apache.replace("License. You may", "License.\n\n  You may").replace("Unless required", "\n\nUnless required")
    gpl = gpl.replace("version. This", "version.\n\nThis").replace("details. You", "details.\n\nYou")
    bsd = bsd.replace("met: 1.", "met:\n\n1.").replace("disclaimer. 2.", "disclaimer.\n\n2.")
    texts = [prose(9, 900) + "\n\n" + x + "\n\n" + prose(10, 900) for x in (apache, gpl, bsd)]
    texts += ["This project is released under the MIT License. " + prose(11, 40), "released under the moon, by the MIT of a License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licences.scan_licences(docs).orderBy("id").collect()
    assert [(r.licence, r.dice) for r in got] == [("Apache-2.0", 1.0), ("GPL-3.0", 1.0), ("BSD-2-Clause", 1.0), ("MIT", 1.0), (None, 0.0)]


def test_licence_runs_are_the_best_of_all():
    rng, some = random.Random(6), {"A": ("a b c d e f g",), "B": ("c d c e a", "b b a")}
    matcher = licences.Matcher(some, 0.6)
    texts = ["".join(rng.choice("abcdefgxy") + rng.choice([" ", " ", "\n\n", ". "]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    pairs = lambda w: set(zip(w, w[1:]))
    for t, (dice, name) in zip(texts, matcher.best(*text_buffers(pa.array(texts)))):
        w, expect = t.replace(".", " ").split(), (0.0, None)
        for n, wordings in some.items():
            for other in (pairs(x.split()) for x in wordings):
                for own in (pairs(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)):
                    d = 2 * len(own & other) / (len(own) + len(other))
                    expect = max(expect, (d, n), key=lambda e: e[0]) if d >= 0.6 else expect
        assert (dice, name) == expect


# op6

PATTERNS = [(re.compile(secrets.ASSIGN[4:], re.I | re.A), 2, 6), (re.compile(secrets.ACCESS), 0, 20), (re.compile(secrets.HEX), 0, 24)]


def test_secrets(spark):
    odd = ["🙂 password: token: abcdefgh", "token=abc token='Abcdef12' SECRET = x.y/z+=1", "AKIA" + "Z9" * 9 + " AKIAAKIA", "0123456789abcdef" * 3 + "g" + "a" * 23, "k Zk3vQ9xW7pL1nB5tR8yM2cD4 example", "APIKEY:abcdef passwd=é"]
    docs = documents(spark, odd)
    rows = secrets.scan_secrets(docs).select("text", "ss_base", "ss_spans").collect()
    for r in rows:
        t = r.text or ""
        expect = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(PATTERNS) for m in p.finditer(t) if len(m[g]) >= n)
        assert [(s.start, s.rank, s.end) for s in r.ss_base] == expect
        assert [s for s in r.ss_spans if s.rank < 3] == r.ss_base
    assert [s.value for r in rows for s in r.ss_spans if s.rank == 3] == ["Zk3vQ9xW7pL1nB5tR8yM2cD4"]
    assert secrets.scan_secrets(empty(docs)).count() == 0


def test_entropy(spark):
    texts = ["a1b2c3d4e5f6a7b8c9d0", "A" * 40 + "B", "0Zx" * 10, "abc", "q9Wz+/7rT0pLm3nVb6Xc2Kd8", "é~é~", ""]

    def brute(s, w=20):
        return max((-sum(v / n * np.log2(v / n) for v in Counter(x).values()) for i in range(max(1, len(s) - w + 1)) if (n := len(x := s[i : i + w]))), default=0)

    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", secrets.most_entropy(F.col("s")).alias("e")).collect()
    assert all(abs(r.e - brute(r.s.replace("é", "~"))) < 1e-9 for r in got)


def test_entropy_of_a_long_run_takes_linear_time(spark):
    rng = random.Random(3)
    run = "".join(rng.choice(secrets.ALPHABET) for _ in range(100_000))
    begin = time.time()
    row = secrets.scan_secrets(spark.createDataFrame([("k " + run,)], "text string")).select("ss_spans").first()
    assert [(s.start, s.rank, s.end) for s in row.ss_spans] == [(2, 3, 100_002)] and time.time() - begin < 30


def test_many_matches_in_a_text(spark):
    """Fifty thousand spans of one kind, and as many candidates among them, in time near their number."""
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(50_000)]
    mixed = [f"token={h[:8]}" if i % 3 == 0 else h if i % 3 == 1 else "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(22)) for i, h in enumerate(hexes[:9000])]
    begin = time.time()
    rows = secrets.scan_secrets(spark.createDataFrame([(" ".join(hexes),), (" ".join(mixed),)], "text string")).select("text", "ss_base", "ss_spans").collect()
    assert time.time() - begin < 60
    for r in rows:
        expect = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(PATTERNS) for m in p.finditer(r.text) if len(m[g]) >= n)
        assert [(s.start, s.rank, s.end) for s in r.ss_base] == expect and all(r.text[s.start : s.end] == s.value or s.rank == 0 for s in r.ss_base)
    covered = {p for s in rows[1].ss_base for p in range(s.start, s.end)}
    extra = [s for s in rows[1].ss_spans if s.rank == 3]
    assert extra and not any(covered & set(range(s.start, s.end)) for s in extra)


# op7

@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_LINES, 0])
def test_lines(spark, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    docs = documents(spark, ["menu\n x \nown", "menu\n\nmenu\nother", "menu\n x "]).withColumns({"ld_keys": F.lit("k"), "hits": F.lit(1), "row": F.lit(2)})
    got = line_dedup.drop_boilerplate(docs, ratio=0.4, min_pages=2).collect()
    rows = [(r.source, r.text) for r in docs.collect()]
    total, pages = Counter(s for s, _ in rows), Counter()
    for s, t in rows:
        pages.update((s, x) for x in set((t or "").split("\n")) if x.strip(" "))
    bad = {k for k, n in pages.items() if n >= 2 and n > 0.4 * total[k[0]]}
    assert all((r.ld_keys, r.hits, r.row) == ("k", 1, 2) for r in got)
    expect = Counter((s, t, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for s, t in rows)
    assert Counter((r.source, r.text, r.ld_text) for r in got) == expect and bad
    assert line_dedup.drop_boilerplate(empty(docs)).count() == 0


def test_pages_by_host(spark, tmp_path):
    """Lines of pages' texts by host of the URL, against the SQL; hosts are compared in lower case, and pages without one are a site."""
    import duckdb

    rows = []
    for i in range(60):
        host = ["a.example.com", "A.EXAMPLE.com:80", "b.example.org", "u:p@c.example"][i % 4]
        body = f"<nav><a href='/x'>Menu</a>\n</nav><p>Line {i} here.</p>\n<p>Foot &amp; note</p><script>var x = '<p>';</script><style>p{{}}</style>" + ("<p>Rare</p>" if i < 5 else "")
        rows.append((i, f"http://{host}/p{i}" if i % 7 else [None, "nohost", ""][i % 3], None if i == 9 else body))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = line_dedup.page_lines(spark, str(tmp_path))
    rel = con.sql(line_dedup.PAGES_SQL)
    assert rel.columns == got.columns and sorted(rel.fetchall(), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    by = {r.page_id: r for r in got.collect()}
    assert by[9].n_lines == 0 and by[1].n_dropped >= 2 and by[1].host == "a.example.com" and by[0].host is None


def test_stage_drops_lines_of_small_sites(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"menu\nown {i}" + "\nrare" * (i in (10, 11)), "en", "small" if i < 5 else "large", 0) for i in range(50)] + [(50, "menu\nalone", "en", "single", 0)]
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.line_dedup_stage(spark, docs, "").collect()}
    # "rare" is on 2 of 45 pages, and one page shows no repetition
    expect = {i: t.removeprefix("menu\n") if i < 50 else t for i, t, *_ in rows}
    assert got == {i: (t, len(t) if i < 50 else 0) for i, t in expect.items()}
    urls = docs.withColumn("url", F.when(F.col("doc_id") < 3, F.lit("HTTPS://me@A.example:80/x?y")).when(F.col("doc_id") == 3, F.lit("http://b.example")))
    got = {r.doc_id: r.text for r in line_dedup.line_dedup_stage(spark, urls, "").collect()}
    assert got == expect | {3: "menu\nown 3", 4: "menu\nown 4"}


# op10

def test_bpe_tells_pretokens_apart_by_bytes(monkeypatch):
    path = public_tokenizers.path(bpe.VOCABULARY)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(path).ranks, special_tokens={})
    text = "the\nten thé tax token other tokens"
    for keys in (bpe.range_keys, lambda data, a, b: np.minimum(b - a, 3).astype(np.uint64)):  # the second collides
        monkeypatch.setattr(bpe, "range_keys", keys)
        ids, at = bpe.TextCoder(path).encode(*text_buffers(pa.array([text, text[4:]])))
        assert ids[: at[1]].tolist() == plain.encode_ordinary(text) and ids[at[1] :].tolist() == plain.encode_ordinary(text[4:])
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    ids, _ = bpe.TextCoder(path).encode(*text_buffers(pa.array([f"{one}\n{two}"])))
    assert ids.tolist() == plain.encode_ordinary(f"{one}\n{two}")


def test_bpe_cuts_and_merges():
    path = public_tokenizers.path(bpe.VOCABULARY)
    coder, cut = bpe.TextCoder(path, remembered=50), regex.compile(public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.encoder.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "it's he'll  don't 're ''s 's 'super I'ma 'l", "a  b   \n c \t\n", "  x", "y  ", "12½ ²日本🙂 🙂", "'", " " * 700 + "a", "x" * 3000, "thntblere" * 40]
    texts += ["".join(rng.choice("ab's tdrelvm \n\t12.,é日🙂ſ'") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    data, offsets = text_buffers(pa.array(texts))
    first, by = bpe.pretokens(data, offsets)
    ends, raw = np.append(first[1:], len(data)), data.tobytes()
    ids, at = coder.encode(data, offsets)
    for i, t in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(first[by[i] : by[i + 1]], ends[by[i] : by[i + 1]])] == cut.findall(t)
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode_ordinary(t)
        assert coder.decode(ids[at[i] : at[i + 1]]) == t.encode()


def test_bpe_forgets_pairs(monkeypatch):
    """What is remembered stays within its bound, and ids are the same."""
    monkeypatch.setattr(bpe, "PAIRS", 5)
    e = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(6)
    for _ in range(300):
        word = "".join(rng.choice("aehnstrié") for _ in range(30))
        assert e.encode(word.encode()) == plain.encode_ordinary(word) and len(e._compatible) <= 5


def test_bpe_checks_the_pattern(monkeypatch):
    assert bpe._public_vocabulary() == public_tokenizers.path(bpe.VOCABULARY)
    monkeypatch.setattr(public_tokenizers, "PATTERN", "x")
    with pytest.raises(ValueError):
        bpe._public_vocabulary()


def test_backtracking_equals_merging():
    rng = random.Random(2)
    for _ in range(20):
        parts = [bytes([b]) for b in range(256)]
        ranks = {p: i for i, p in enumerate(parts)}
        pool = [b"a", b"b", b"c"]
        while len(ranks) < 276:
            t = rng.choice(pool) + rng.choice(pool)
            if t not in ranks:
                ranks[t] = len(ranks)
                pool.append(t)
        e = bpe.Encoder.of(ranks)
        for _ in range(60):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
            expect = [ranks[piece]] if piece in ranks else [ranks[t] for t in e.merged(piece)]
            assert e.encode(piece) == expect
    with pytest.raises(ValueError):
        bpe.Encoder.of({b"a": 0})


def test_bpe_rows(spark):
    docs = documents(spark)
    got = bpe.encode_texts(docs, public_tokenizers.path(bpe.VOCABULARY), with_ids=True).collect()
    assert len(got) == docs.count()
    for r, t in zip(got, [x.text for x in docs.collect()]):
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_texts(empty(docs), public_tokenizers.path(bpe.VOCABULARY)).count() == 0
