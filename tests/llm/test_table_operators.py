"""URL filter, WARC, decontamination, SimHash, HTML and the pipeline: against plain versions and on odd rows."""

import base64
import hashlib
import html
import html.parser
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import common, decontaminate, html_extract, queries, simhash, url_filter, warc

SF = "/root/testdata/sf0.001"


def test_cascade_is_exact_over_its_universe():
    rng = random.Random(1)
    universe = {f"h{rng.randrange(10**9)}.example.com/" for _ in range(20_000)}
    listed = set(rng.sample(sorted(universe), 150))
    first = url_filter.Bloom.of(listed, url_filter.first_rate(len(listed), len(universe)), 1)
    passed = {k for k in universe - listed if k in first}
    cascade = url_filter.Cascade.finish(first, listed, passed)
    assert {k for k in universe if k in cascade} == listed and passed and len(passed) < 8 * len(listed)


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search("[/?#]", rest)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: cut.start() if cut else len(rest)])
        path = re.split("[?#]", rest[len(host) :])[0]
    fits = [r for r in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, rules[rule] if rule else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://Sub.EXAMPLE.com/en/71", "http://example.com/en/8", "http://example.com", "x://net/de/", "http://a.example.net/de/88?x#y", "http://example.net/de/9", "http://badexample.net/de/8", "http://org/es/", "http://É.com/en/", "a://b://c.com/en/", "http://q?com/en/", "http://" + "a." * 20_000 + "com/en/" + "z" * 5000]
    rules = queries.RULES
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(99, urls[4], "again")] * 2, "page_id long, url string, key string")
    rows = url_filter.judge(df, rules).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain_judge(urls[4] if r.page_id == 99 else urls[r.page_id], rules)
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_warc(spark):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (9, "http://c\r\nX: y", "same"), (3, None, None), (4, "http://d", ""), (5, "http://é", "é" * 200_000), (None, "http://n", "same"), (7, "u", "alone")] + [(100 + i, "u", f"<p>record {i} of many, with words in common</p>") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("n", common.F.lit(1)).withColumn("top", common.F.lit("x"))
    archives = warc.write(df)
    rows = warc.read(archives).collect()
    assert len(rows) == len(pages)
    groups = {}
    for i, _, h in pages:
        groups.setdefault(h or "", []).append(i)
    for r in rows:
        _, _, h = next(p for p in pages if p[0] == r.page_id)
        payload = (h or "").encode()
        best = max((i for i in groups[h or ""] if i is not None), default=None)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == best else ("revisit", best))
    data = [bytes(a.data) for a in archives.collect()]
    assert any(d[:4] == b"\x5d\x2a\x4d\x18" for d in data)
    payloads = {x[0]: x[5] for d in data for x in warc.parse(d) if x[3] == "response"}
    assert payloads[5] == ("é" * 200_000).encode() and payloads[150].startswith(b"<p>record 50")
    assert all(d[:4] == b"\x5d\x2a\x4d\x18" for d in data)
    few = df.where("page_id IN (1, 3, 4, 7)")
    small = [bytes(a.data) for a in warc.write(few.coalesce(1)).collect()]
    assert small and all(d[:4] == b"\x5d\x2a\x4d\x18" for d in small) and warc.read(warc.write(few)).count() == 4
    short = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(warc.write(df, least=5)).collect()}
    assert short[1] == short[7] == short[4] == ("response", None) and all(t == "response" for t, _ in short.values())
    assert warc.read(warc.write(df.limit(0))).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        list(warc.frames(data[0][:-3]))


def test_hot_keys_meet_once(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (3, 2)], "k int, v int")
    groups = rows.groupBy("k").agg(common.F.max("v").alias("m"), common.F.count(common.F.lit(1)).alias("n")).where("k < 3")
    assert common.lookup_by_hot_key(rows, groups, "k").count() == 501
    assert common.lookup_by_hot_key(rows, groups, "k", "left").count() == 502


def plain_windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w


def plain_contamination(docs, items):
    wins = {}
    for i, t in items:
        w = plain_windows(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = plain_windows(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= ids
        listed = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("red Blue green één 7 the a of".split()) for _ in range(n))
    items = [(1, say(30)), (2, say(13)), (3, "only four words here"), (4, "zebra"), (5, None), (6, ""), (7, say(20)), (7, say(20)), (None, "nobody owns this"), (8, " ".join(["na"] * 20))]
    docs = [(1, None), (2, ""), (3, say(3000) + " " + items[0][1]), (4, items[1][1].upper()), (4, items[1][1].upper()), (5, "x, ONLY four-words here! zebra"), (None, items[6][1] + " " + items[7][1]), (6, " ".join(["na"] * 50)), (7, "nobody owns this"), (8, say(400)), (9, " ".join(items[0][1].split()[3:17]) + " tail")]
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, k int, w string, h string")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.judge(df, bench).drop("th").collect()
    assert sorted(map(tuple, got), key=repr) == plain_contamination(docs, items)
    bad = [r[0] for r in plain_contamination(docs, items) if r[5]]
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len(bad)
    assert decontaminate.judge(df, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.judge(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination_of_a_very_long_text(spark, monkeypatch, broadcast):
    """Hits at both ends and in runs that overlap, of a text of 200,000 words, within a bounded time."""
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    say = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(1, say(40, 500)), (2, say(13, 500)), (3, " ".join(["na"] * 15))]
    text = " ".join([items[0][1], say(120_000, 900), items[1][1], "na " * 5000, say(75_000, 900), items[0][1][:-1], items[0][1]])
    df = spark.createDataFrame([(1, text), (2, items[1][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    began = time.monotonic()
    got = decontaminate.judge(df, bench).drop("th").collect()
    assert time.monotonic() - began < 90
    assert sorted(map(tuple, got), key=repr) == plain_contamination([(1, text), (2, items[1][1])], items)


def test_items_of_one_window_are_one_set(spark):
    listed = spark.createDataFrame([(i, "one two three four five six") for i in range(50)] + [(99, "seven eight nine")], "item_id long, text string")
    wins, members = decontaminate.distinct_windows(common.written(decontaminate.windows(listed), "test-windows"))
    assert wins.count() == 2 and members.count() == 51
    got = decontaminate.judge(spark.createDataFrame([(1, "x ONE two three four five six y seven eight nine")], "doc_id long, text string"), listed).first()
    assert (got.n_hit, got.n_items) == (9, 51)


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints):
    x = np.array(prints, np.uint64)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_simhash_is_the_plain_one(spark, documents, odd):
    both = documents.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in both]
    roots = plain_components(prints)
    least = {}
    for r, root in zip(both, roots, strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(documents).collect()}
    assert got == {r.doc_id: (f"{p:016x}", least[root]) for r, p, root in zip(both, prints, roots, strict=True)}
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(least.values()))
    rows = simhash.classes(odd).collect()
    zero = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert len(rows) == odd.count() and {(r.fingerprint, r.component_id) for r in zero} == {("0" * 16, 1)}
    assert simhash.keep_one(odd).where("doc_id = 4").count() == 1 and simhash.keep_one(odd).where("doc_id IN (1, 2, 3)").count() == 1
    assert simhash.classes(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_components_of_dense_clusters(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(simhash, "LARGE", 64)
        monkeypatch.setattr(simhash, "CHUNK", 64)
        monkeypatch.setattr(simhash, "HOT", 20)
        monkeypatch.setattr(simhash, "HUBS", 8)
        monkeypatch.setattr(common, "HOT", 20)
    rng = np.random.default_rng(8)
    points = set()
    for spread in (3, 7, 9, 12):
        center = int(rng.integers(1, 1 << 63))
        for _ in range(400):
            x = center
            for b in rng.choice(64, rng.integers(0, spread), replace=False):
                x ^= 1 << int(b)
            points.add(x)
    points = sorted(points)
    want = plain_components(points)
    df = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(points)], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in simhash.components(df).collect()} == dict(enumerate(want))


def test_a_large_shard_that_is_no_cluster(spark, monkeypatch):
    """50,000 unlike points that share their first 13 bits, so that one shard holds them all, and 400 that have a partner:
    the shard is split, not compared as pairs."""
    monkeypatch.setattr(simhash, "LARGE", 4096)
    rng = np.random.default_rng(12)
    points = rng.integers(0, 1 << 51, 50_000, np.uint64) << np.uint64(13)
    near = points[:400].copy()
    for k in range(len(near)):
        for b in rng.choice(np.arange(13, 64), 1 + k % 4, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(int(b))
    whole = np.unique(np.concatenate([points, near]))
    df = spark.createDataFrame([(int(x),) for x in whole.view(np.int64)], "fp long")
    compared = []
    direct = simhash.large_links
    monkeypatch.setattr(simhash, "large_links", lambda p, large, most: compared.append((large.count(), most)) or direct(p, large, most))
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    want = set()
    for a in (points[:400], near):
        for x in a:
            for y in whole[np.bitwise_count(whole ^ x) <= 4]:
                if x != y:
                    i, j = int(x.view(np.int64)), int(y.view(np.int64))
                    want.add((max(i, j), min(i, j)))
    assert compared and all(most is not None for _, most in compared)
    parent = {}
    for links in (got, want):
        up = {}
        for a, b in sorted(links):
            up.setdefault(a, a), up.setdefault(b, b)
        def root(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in sorted(links):
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
        parent[len(parent)] = {x: root(x) for x in up}
    assert all(parent[0].get(x) == r for x, r in parent[1].items())
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 or parent[0][a] == parent[0][b] for a, b in got)


def test_blocks_and_extraction(spark):
    model = html_extract.train(html_extract.labelled_pages(300))
    page = "<html><head><title>t</title><script>'</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n two<br>three.<p>Four <b>bold.</p><div class=ad>Buy now.</div><p>Five.</article><!-- <p>no --><footer>&copy; x</footer>"
    assert [b.text for b in html_extract.blocks(page)] == ["Home", "A & B", "One two three.", "Four bold.", "Buy now.", "Five.", "© x"]
    assert model.extract(page) == "A & B\n\nOne two three.\n\nFour bold.\n\nFive."
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (None, "u", "<"), (4, "u", "<p>" * 3000 + "x" + "<div" * 2000), (5, "u", "plain " * 20_000)]
    out = html_extract.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string"), model).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out) and {r.text for r in out if r.page_id in (1, 2)} == {""}


def test_features_see_every_class_word_and_long_notices():
    utilities = " ".join(f"{a}{b}" for a in "pqrs" for b in "wxyz")
    page = f'<body><p class="{utilities} sidebar">One two.</p><div class="{utilities}" id="comments">Three.</div><p>{"word " * 100}cookie consent.</p>'
    one, two, three = html_extract.blocks(page)
    assert "c:sidebar" in html_extract.path_features(one.path) and "c:comments" in html_extract.path_features(two.path)
    assert len(three.text) > 400 and "cue" in html_extract.text_features(three)


def test_field_on_pages_it_has_not_seen():
    pages = html_extract.labelled_pages(500, seed=21)
    model = html_extract.train(pages[:400])
    pairs = [(a, b) for page, labels in pages[400:] for a, b in zip(model.decode(page), labels, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95


def test_viterbi_is_the_best_of_all():
    import itertools

    pages = html_extract.labelled_pages(60)
    model = html_extract.train(pages, epochs=2)
    for page, _ in [p for p in pages if 2 <= len(p[0]) <= 9][:15]:
        s = model.scores(page)
        value = lambda y: sum(x for x, k in zip(s, y, strict=True) if k) + y[0] * model.first + sum(model.moves[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(page)), key=value)
        assert value(tuple(model.decode(page))) == pytest.approx(value(best))


def test_gradient_of_the_field_is_that_of_its_likelihood():
    """One step of training on one page against differences of the log-likelihood over all labellings."""
    import itertools

    page, labels = next((p[:6], y[:6]) for p, y in html_extract.labelled_pages(80) if 0 < sum(y[:6]) < len(y[:6]) - 1)
    rows = [html_extract.path_features(b.path) + html_extract.text_features(b) for b in page]

    def likelihood(weights, first, moves):
        score = lambda y: sum(sum(weights.get(f, 0.0) for f in r) for r, k in zip(rows, y, strict=True) if k) + y[0] * first + sum(moves[a][b] for a, b in itertools.pairwise(y))
        every = [score(y) for y in itertools.product((0, 1), repeat=len(rows))]
        return score(labels) - float(np.logaddexp.reduce(every))

    # Adagrad's first step is rate * gradient / sqrt(1e-6 + gradient ** 2): its sign, and size where the gradient is large.
    step = html_extract.train([(page, labels)], epochs=1, rate=1.0)
    zero, h = {}, 1e-5
    for f in sorted({f for r in rows for f in r}):
        slope = (likelihood({f: h}, 0, [[0, 0], [0, 0]]) - likelihood({f: -h}, 0, [[0, 0], [0, 0]])) / (2 * h)
        assert step.weights[f] == pytest.approx(slope / np.sqrt(1e-6 + slope**2), abs=1e-3), f
    slope = (likelihood(zero, h, [[0, 0], [0, 0]]) - likelihood(zero, -h, [[0, 0], [0, 0]])) / (2 * h)
    assert step.first == pytest.approx(slope / np.sqrt(1e-6 + slope**2), abs=1e-3)
    for a, b in itertools.product((0, 1), repeat=2):
        shift = lambda d: [[d * ((i, j) == (a, b)) for j in (0, 1)] for i in (0, 1)]  # noqa: B023, E731
        slope = (likelihood(zero, 0, shift(h)) - likelihood(zero, 0, shift(-h))) / (2 * h)
        assert step.moves[a][b] == pytest.approx(slope / np.sqrt(1e-6 + slope**2), abs=1e-3)


class PlainBlocks(html.parser.HTMLParser):
    """Blocks of well-formed markup: text between tags that are not inline, with the tags around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.held = [], [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        if text and not any(t in html_extract.HIDDEN for t in self.stack):
            self.found.append((text, tuple(self.stack)))
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.INLINE:
            return
        if tag == "br":
            self.held.append(" ")
            return
        self.flush()
        if tag not in html_extract.VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag not in html_extract.INLINE:
            self.flush()
            self.stack.pop()

    def handle_data(self, data):
        self.held.append(data)


def test_blocks_are_those_of_another_parser():
    rng = random.Random(11)

    def tree(depth):
        out = []
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            if k < 0.4 or depth > 6:
                out.append(rng.choice(("word", " two words ", "a &amp; b", "&#233;&eacute;", "<b>bold</b>", "<a href='x>y'>link</a>", "<br>", "x<!-- <p>gone</p> -->y", "<em title=\"a > b\">e</em>", "\n")))
            else:
                t = rng.choice("div section ul blockquote article svg h2 center pre".split())
                out.append(f"<{t} class='c{rng.randint(0, 3)}'>{tree(depth + 1)}</{t}>")
        return "".join(out)

    for _ in range(1500):
        page = tree(0)
        plain = PlainBlocks()
        plain.feed(page)
        plain.close()
        plain.flush()
        got = []
        for b in html_extract.blocks(page):
            at, around = b.path, []
            while at is not None:
                around.append(at.tag)
                at = at.around
            got.append((b.text, tuple(reversed(around))))
        assert got == plain.found, page


@pytest.mark.parametrize("piece", ["<div>x", "<center>x", "<a ", '<a ">" ', "<p>x</x>", "<div class=a>x<p>", "<li>x<ul>", "<!--", "<x '", "&#" + "9" * 60])
def test_markup_of_any_kind_takes_linear_time(piece):
    model = html_extract.Model({}, 0.0, [[0.0, 0.0], [0.0, 0.0]])
    began = time.process_time()
    model.extract(piece * 40_000)
    assert time.process_time() - began < 4


def test_pages_of_the_tables(spark):
    rows = queries.op9_crf_main_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    same = 0
    for r in rows:
        inner = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        same += r.text == "\n\n".join(p for p in parts if p)
    assert same >= 0.98 * len(rows)


def test_pipeline(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
    assert 0 < corpus_pipeline.run(spark, SF).count() == docs.count() < 200


def test_stages_on_odd_rows(spark, odd):
    """Null, empty, repeated and very long texts, a null id, and columns whose names stages use inside."""
    for clash in ("fp", "uid", "th", "w", "at", "n"):
        docs = odd.select("doc_id", "text", F.lit("x").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(3).alias(clash))
        for name, stage in corpus_pipeline.STAGES[: 4 if clash == "fp" else 3]:
            if clash != "fp" and name == "quality classifier":
                continue
            docs = common.written(stage(spark, docs, SF), "odd-stage")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", clash] and all(r[clash] == 3 for r in docs.collect())
    dedup = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, odd, SF).collect()
    assert sorted((r.doc_id for r in dedup), key=repr) == [1, 4, 5, 6, 7, 8, None]
    tokens = dict(corpus_pipeline.STAGES)["byte-level BPE"](spark, odd, SF)
    assert tokens.count() == odd.count()


def test_stages_on_nothing(spark, tmp_path):
    """Every table empty: every stage gives no rows and fails nowhere."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_scratch_tables_go_and_results_stay(spark):
    before = spark.range(5)
    with common.scratch(spark):
        inner = common.written(before, "gone")
        path = inner.inputFiles()[0]
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(jvm)
    stays = common.written(before, "stays")
    assert stays.count() == 5


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
