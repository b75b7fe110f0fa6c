"""The corpus operators against brute force, round trips and held-out accuracy on small fixtures."""

import hashlib
import html
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import decontaminate, html_text, id_store, language_id, packing, quality_rules, suffix_dedup, token_counts, url_filters
from tilewright.llm.common import WordTokenizer, default_tokenizer
from tilewright.llm.words import text_buffer, word_hashes

SF = "/root/testdata/sf0.001"
#: Extra columns whose names clash with results.
DOCS = "doc_id long, text string, n_words long, kept string, length long, piece string, start string, score string, item_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", "z", "s", "i") for i, t in rows], DOCS)


ODD = [(None, "no id at all, but a text that is long enough to be cut " * 2), (1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (5, "ä" * 3000), (6, "a b " * 20_000), (7, "\0\x1c\xa0 x  y\n\nz\r\n")]


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(default_tokenizer())


def test_tokenizer_gives_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "a", "the", "'s", "é", "12", "!", "\t", "　", "\x1c", "x.", "\r\n", "<|endoftext|>", "中", "\0", "\xa0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(5000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokenizer.encode(texts) == want


def test_tokenizer_knows_added_tokens(tokenizer):
    plain = Tokenizer.from_file(default_tokenizer())
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "no such token"]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert tokenizer.encode(texts) == want and len(want[0]) == 4


def test_word_hashes_tell_words_apart():
    texts = ["The the  THE\tcat", None, "", " x", "cat-x é É"]
    h, at = word_hashes(*text_buffer(pa.array(texts)))
    assert at.tolist() == [0, 4, 4, 4, 5, 8]
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 6


# --- 1


def removed(rows):
    first = {}
    last = 1 << 63
    for i, t in sorted(((last if i is None else i, t) for i, t in rows), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cov = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (last if i is None else i):
                cov[k : k + 50] = True
        runs = int((np.diff(cov.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(cov.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cov].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ab \nCé", k=rng.randint(0, 400))) for _ in range(20)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            a, b = sorted((rng.randint(0, len(x)), rng.randint(0, len(x))))
            t += x[a:b] + rng.choice(["", "q" * rng.randint(0, 80), "ab" * rng.randint(0, 60)])
        rows.append((i * 3 % 79, t))
    rows += [(i and 100 + i, t) for i, t in ODD]
    got = suffix_dedup.dedup(docs(spark, rows), run_bytes=6000, bucket_bytes=8000).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)


def test_suffix_dedup_of_long_and_empty_and_carried(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 3000)
    rng = random.Random(8)
    long = "".join(rng.choices("abcdef \n", k=20_000))
    rows = [(1, long[4000:4300]), (2, long), (3, long[2950:3060] + "x" + long[8990:9100]), (4, "")]
    got = suffix_dedup.dedup(docs(spark, rows), with_text=True, carry=["n_words", "kept"], run_bytes=5000, bucket_bytes=4000).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == removed(rows)
    assert all(tuple(r["row"]) == (1, "x") for r in got) and {r["doc_id"]: r["kept"] for r in got}[1] == long[4000:4300]
    assert suffix_dedup.dedup(docs(spark, [])).collect() == []


def test_loser_tree():
    rng = random.Random(9)
    prefix = lambda p, q: next((i for i in range(min(len(p), len(q))) if p[i] != q[i]), min(len(p), len(q)))
    for _ in range(200):
        runs = []
        for _ in range(rng.randint(1, 6)):
            x = sorted({bytes(rng.choices(b"ab\0", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8))})
            runs.append((x, [0, *map(prefix, x, x[1:])][: len(x)]))
        order, shared = suffix_dedup.merge_runs(runs)
        its = [iter(r[0]) for r in runs]
        out = [next(its[i]) for i in order]
        assert out == sorted(sum((r[0] for r in runs), []))
        assert shared[1:] == list(map(prefix, out, out[1:]))


# --- 2


def test_greedy_counts():
    rng = random.Random(3)

    def greedy(vocabulary, word):
        i = n = 0
        while i < len(word):
            size = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in vocabulary), 0)
            if not size:
                return 1
            i, n = i + size, n + 1
        return n

    for _ in range(1500):
        v = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        a = token_counts.Automaton(v)
        for _ in range(4):
            w = bytes(rng.choices(b"abc", k=rng.randint(0, 10)))
            assert a.count(w) == greedy(v, w)


def test_token_counts(spark):
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs(spark, ODD)).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 1)} <= got


def test_token_counts_against_greedy_pieces(spark):
    pieces, rng = set(token_counts.byte_pieces(default_tokenizer())), random.Random(5)
    longest = max(map(len, pieces))

    def greedy(word):
        i = n = 0
        while i < len(word):
            size = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
            if not size:
                return 1
            i, n = i + size, n + 1
        return n

    rows = ODD + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [(900, "".join(rng.choices("abcé", k=20_000)))]
    got = token_counts.token_counts(docs(spark, rows), max_words=50).collect()
    split = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in rows]
    assert Counter(map(tuple, got)) == Counter((i, len(w), sum(map(greedy, w))) for i, w in split)
    assert token_counts.token_counts(docs(spark, [])).collect() == []


# --- 4


def test_quality_measures(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["a", "b", "the#", "Und", "x|y"], k=rng.randint(0, 90))) + rng.choice(["", "\nsame\nsame\n \n"])) for i in range(40)] + [(i and 100 + i, t) for i, t in ODD]
    text = dict(rows)
    for r in quality_rules.quality(docs(spark, rows)).collect():
        t = text[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = set()
        for k in range(len(w) - 7):
            if wins[tuple(w[k : k + 8])] > 1:
                again.update(range(k, k + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_uses_no_python(spark):
    plan = quality_rules.quality(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- 5


def test_plans_are_packings():
    rng = random.Random(8)
    for _ in range(150):
        limit = rng.choice([10, 20, 50])
        counts = Counter(rng.randint(1, limit) for _ in range(rng.randint(1, 40)))
        p = packing.plan(dict(counts), limit)
        used = Counter()
        for contents, times in p:
            assert sum(a * b for a, b in contents) <= limit
            for a, b in contents:
                used[a] += b * times
        assert used == counts
        assert sum(n for _, n in p) <= sum(n for _, n in packing.best_fit_decreasing(dict(counts), limit))


def fewest_bins(items, limit):
    """By trying every bin for every piece, largest first."""
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            rest = list(bins)
            rest.remove(room)
            put(i + 1, [*rest, room - items[i]])
        put(i + 1, [*bins, limit - items[i]])

    items = sorted(items, reverse=True)
    put(0, [])
    return best


def test_plans_branch_over_fillings_of_equal_sum():
    for n in (4, 40, 1000):
        counts = {k: n for k in (900, 850, 800, 750, 700, 600, 448)} | {548: 2 * n}
        assert sum(times for _, times in packing.plan(counts, 2048)) == 3 * n


def test_plans_are_optimal_on_small_inputs():
    rng = random.Random(5)
    for _ in range(300):
        limit = rng.choice([12, 20, 30])
        items = [rng.randint(2, limit * 2 // 3) for _ in range(rng.randint(1, 11))]
        assert sum(times for _, times in packing.plan(dict(Counter(items)), limit)) == fewest_bins(items, limit)


def test_packing(spark, tokenizer):
    rows = ODD + [(20 + i, "lorem ipsum " * (i * 37 % 700)) for i in range(30)]
    got = packing.pack(docs(spark, rows)).collect()
    ids = {i: tokenizer.encode([t])[0] + bytes(4) for i, t in rows}
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        assert r["length"] == 2048 or r["piece"] == 0
    assert sum(r["length"] for r in got) == sum(len(tokenizer.encode([t])[0]) // 4 + 1 for _, t in rows)
    by = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048 and len(by) <= -(-sum(by.values()) // 2048) + 1
    assert packing.pack(docs(spark, [])).collect() == []


# --- 6


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choices(words, k=rng.randint(16, 40))) for _ in range(20)] + ["short one two three four five six", None, ""]
    clean = lambda n: " ".join(rng.choices(words, k=n))
    rows, want = [(i, t) for i, t in ODD], set()
    for k in range(20):
        own = items[k].split()
        for j in rng.sample(range(3, len(own), 7), 1):
            own[j] = "changed"
        rows.append((100 + k, f"{clean(50)}. {' '.join(own).upper()}, {clean(20)}"))
        want.add((100 + k, k))
        rows.append((200 + k, clean(200)))
        rows.append((300 + k, clean(20) + " " + " ".join(own[:8]) + " " + clean(20)))  # too little of it
    rows.append((400, "say: short one two THREE four five six!"))
    want.add((400, 20))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert got == want


def alignments(rows, items):
    """Every alignment of every document with every item: those that pass, the best of each pair."""
    words = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = set()
    for i, t in rows:
        for k, u in items:
            d, w, best = words(t), words(u), None
            need = min(13, len(w))
            for shift in range(-len(w) + 1, len(d)) if w and d else ():
                lo, hi = max(0, -shift), min(len(w), len(d) - shift)
                equal = [w[j] == d[j + shift] for j in range(lo, hi)]
                if any(100 * sum(equal[j : j + need]) >= 80 * need for j in range(len(equal) - need + 1)):
                    best = max(best or (0, 0), (sum(equal), lo + shift + equal.index(True)))
            if best:
                out.add((i, k, len(w), *best))
    return out


def test_decontamination_against_all_alignments(spark):
    """A seed of six words in a row, or one of the other masks, lies in every stretch that has at most one substitution; others are found if a mask fits."""
    rng = random.Random(12)
    words = [f"v{i}" for i in range(40)]
    stem = rng.choices(words, k=14)
    items = [(k, " ".join([*stem[: rng.choice([0, 14])], *rng.choices(words, k=rng.randint(1, 20))])) for k in range(60)]
    rows = [(None, items[3][1]), (7, None)]
    for k in range(80):
        own = items[k % 60][1].split()
        if len(own) > 5 and k % 3:
            own[rng.randrange(len(own))] = "zz"
        rows.append((100 + k, " ".join(rng.choices(words, k=5)) + " " + " ".join(own) + " " + " ".join(stem[:12])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    want = alignments(rows, items)
    assert got <= want
    missed = want - got
    # What is missed has a stretch with two substitutions or more and no mask that fits beside them.
    assert len(missed) <= 0.02 * len(want)
    assert {(r[0], r[1]) for r in got} >= {(100 + k, k % 60) for k in range(80)}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.overlaps(docs(spark, ODD), none).collect() == []
    assert decontaminate.overlaps(docs(spark, []), some).collect() == []
    repeated = decontaminate.overlaps(docs(spark, [(4, "a b c"), (4, "a b c")]), spark.createDataFrame([(1, "a b c"), (2, "a b c")], "item_id long, text string"))
    assert sorted(tuple(r)[:2] for r in repeated.collect()) == [(4, 1), (4, 1), (4, 2), (4, 2)]


def test_decontamination_of_a_long_text_and_a_large_benchmark(spark):
    rng = random.Random(3)
    stem = [f"s{j}" for j in range(20)]
    items = [(k, " ".join([*stem, f"own{k}", f"more{k}"])) for k in range(500)]
    long = " ".join(rng.choices([f"u{j}" for j in range(5000)], k=150_000)) + " " + items[77][1]
    got = {(r["doc_id"], r["item_id"], r["n_equal"]) for r in decontaminate.overlaps(docs(spark, [(1, long), (2, "u1 u2 u3")]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, k, 22 if k == 77 else 20) for k in range(500)}


def test_seed_map_knows_its_seeds(spark):
    rows = [(k, f"w{k} x{k} y{k}") for k in range(300)]
    held = decontaminate.benchmark_seeds(decontaminate.benchmark_items(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text"))
    table = decontaminate.seed_map(held)
    h = np.asarray([r["seed"] for r in held.collect()], np.int64).view(np.uint64)
    assert len(decontaminate.known(h, table)) == len(h)
    assert len(decontaminate.known(np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64), table)) < 50


def test_decontamination_of_short_items(spark):
    rows, want, items = [], set(), []
    for n in range(1, 14):
        item = [f"w{n}x{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        for changed in range(min(n, 3) + 1):
            for places in itertools.combinations(range(n), changed):
                own = ["x" if j in places else w for j, w in enumerate(item)]
                for text in (" ".join(["a", "b", *own, "c"]), " ".join(own)):
                    if 100 * (n - changed) >= 80 * n:
                        want.add((len(rows), n))
                    rows.append((len(rows), text))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == want


def test_decontamination_of_short_items_in_tables(spark):
    rows = [(1, "yes"), (2, "he said Yes, twice: yes"), (3, "one two three four"), (4, "one two x four"), (5, "a b c d e f"), (6, "a b X d e f!"), (7, "a b X d Y f")]
    bench = spark.createDataFrame([(1, "yes"), (2, "One two three four"), (3, "a b c d e f"), (4, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item_words"], r["n_equal"]) for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert got == {(1, 1, 1, 1), (2, 1, 1, 1), (3, 2, 4, 4), (5, 3, 6, 6), (6, 3, 6, 5)}


# --- 7


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>two</b><i>x</i><br>three<p>Fo\xa0ur</p><script>var t="</p>";</script>
    <div class="comments"><p>Nice!</p></div><ul><li>a<li>b</ul></article><aside>Side</aside><form>Mail<input></form><footer>Foot</footer></body></html>"""
    assert html_text.Page(page).main() == ["A & B", "One twox three", "Fo ur", "a", "b"]
    assert html_text.Page("plain < text &lt;b&gt;").main() == ["plain < text <b>"]
    for broken in ("", "<", "<p", "</p></div>", "<div><p>x", "<!-- x", "<script>x"):
        html_text.Page(broken).main()


def test_html_names_never_empty_a_page():
    for page in ('<article class="post comments-open"><p>Hi</p></article>', '<div class="content has-sidebar"><p>Hi</p></div>', '<main class="page-with-nav"><p>Hi</p></main>', "<body><form action=x><p>Hi</p></form></body>", '<div class="comments"><p>Hi</p></div>'):
        assert html_text.Page(page).main() == ["Hi"]
    assert html_text.Page("<nav>Menu</nav><footer>Foot</footer>").main() == []
    assert html_text.Page('<div class="sidebar">S</div><div class="layout has-sidebar"><p>Hi</p></div>').main() == ["Hi"]


def test_html_reads_hostile_pages_in_linear_time():
    def seconds(source):
        began = time.perf_counter()
        page = html_text.Page(source)
        page.main({1})
        page.subtrees()
        return time.perf_counter() - began

    shapes = (lambda n: "<a " * n, lambda n: "<div>x" * n, lambda n: '<a ">' * n, lambda n: '<a "x>" ' * n, lambda n: "<svg/>" * n, lambda n: "<p><div>" + "<span>" * n + "<ul></ul>" * n, lambda n: "<b>" * n + "<ul></ul>" * n, lambda n: "<!--" * n, lambda n: "<p>" + "long text " * n)
    for shape in shapes:
        small, large = shape(3000), shape(24_000)
        assert min(seconds(large) for _ in range(2)) < 40 * max(min(seconds(small) for _ in range(3)), 0.005)


def test_html_templates_of_pages_whose_names_say_nothing(spark):
    """Menu, notice and footer stand in plain elements, with links of their own; only their recurrence tells."""
    page = "<body><div><div><a href='/p/{i}'>Home</a> <a>News</a></div><p>Cookies are used here</p></div><div><h2>Title {i}</h2><p>Body of text {i}, which stands alone.</p><div><p>Read more like text {i}</p></div></div><div><p>All rights reserved</p></div></body>"
    rows = [(i, f"http://n.example/a/{i}", page.replace("{i}", str(i)), "x", "y") for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r["text"] for r in got.collect()} == {f"Title {i}\nBody of text {i}, which stands alone.\nRead more like text {i}" for i in range(20)}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_templates(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Welcome to our site</div><p>Text number {i} stands alone</p></body>") for i in range(12)]
    rows += [(50, None, None), (51, "http://h.example/x", ""), (52, "bad", "<p>Only</p>"), (53, "http://h.example/0", rows[0][2])]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text number 3 stands alone" and got[53] == got[0] and (got[50], got[51], got[52]) == ("", "", "Only")
    joined = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_rows=0).collect()}
    assert joined == got


def test_html_templates_of_sections(spark):
    rows = [(100 * k + i, f"http://h.example/{lang}/{i}", f"<body><div>{lang} edition</div><p>Text {lang} {i} stands alone</p></body>") for k, lang in enumerate(("en", "de", "fr", "es")) for i in range(8)]
    rows += [(900 + i, f"http://h.example/{i}.html", f"<body><p>Root {i}</p><div>en edition</div></body>") for i in range(3)]
    rows += [(950, "http://h.example/de/x?y=/z/", "<body><div>de edition</div></body>"), (951, "http://h.example/fr/deep/er/", "<body><div>fr edition</div><p>More</p></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (50_000, 0):
        got = {r["page_id"]: r["text"] for r in html_text.extract(pages, broadcast_rows=most).collect()}
        assert [got[100 * k + 3] for k in range(4)] == [f"Text {x} 3 stands alone" for x in ("en", "de", "fr", "es")]
        assert got[900] == "Root 0\nen edition" and got[950] == "" and got[951] == "More"


def test_html_on_pages(spark):
    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


# --- 8


def test_store_round_trip(spark, tokenizer, tmp_path):
    rng = random.Random(6)
    shared = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "x1", "y2"], k=3000))
    rows = ODD + [(20 + i, shared[: 4000 + 500 * i] + f" end {i}") for i in range(12)] + [(90 - i, shared) for i in range(4)]
    root = id_store.write(docs(spark, rows), f"file://{tmp_path}/store")
    want = Counter((i, tokenizer.encode([t])[0] + (2).to_bytes(4, "little")) for i, t in rows)
    got = id_store.read(spark, root).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(id_store.digest_rows(spark, root).collect(), key=lambda r: (r["doc_id"] or 0, r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]
    assert id_store.verify(spark, root).count() == 0
    stored = spark.read.parquet(f"{root}/store").where("root IS NULL").agg(F.sum(F.length("ids"))).first()[0]
    assert stored < sum(len(k[1]) // 2 * n for k, n in want.items()) * 0.6


def test_store_notices_lost_and_changed_parts(spark, tmp_path):
    rows = [(i, f"text number {i} " * 400) for i in range(60)]
    root = id_store.write(docs(spark, rows), f"file://{tmp_path}/store")
    assert id_store.verify(spark, root).count() == 0 and id_store.digest_rows(spark, root).count() == 60
    files = sorted(p for p in (tmp_path / "store" / "store").iterdir() if p.suffix == ".parquet")
    files[0].rename(tmp_path / "lost")
    assert id_store.verify(spark, root).count() > 0
    with pytest.raises(ValueError):
        id_store.digest_rows(spark, root)


def test_store_of_hot_chunks_and_of_nothing(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(id_store, "HOT", 5)
    common = " ".join(random.Random(3).choices(["one", "two", "three", "four", "five"], k=2500))
    rows = [(i, f"{common} tail {i}") for i in range(40)] + [(99, common + " <|endoftext|>")]
    root = id_store.write(docs(spark, rows), f"file://{tmp_path}/hot")
    flags = {f for r in id_store.recipes(spark, root).collect() for f in r["shared"]}
    assert {3, 4} <= flags
    plain = Tokenizer.from_file(default_tokenizer())
    want = {i: np.asarray([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows}
    assert {r["doc_id"]: bytes(r["ids"]) for r in id_store.read(spark, root).collect()} == want
    empty = id_store.write(docs(spark, []), f"file://{tmp_path}/none")
    assert id_store.read(spark, empty).collect() == [] and id_store.digest_rows(spark, empty).collect() == []


def test_chunks_are_bounded_and_local():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000).astype("<u2")
    ends = id_store.cuts(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= id_store.MOST
    moved = id_store.cuts(np.concatenate([ids[:100], ids]))
    assert len(set(e + 100 for e in ends) & set(moved)) > 0.9 * len(ends)
    tree = id_store.Merkle()
    leaves = [bytes([i]) * 16 for i in range(8)]
    for x in leaves:
        tree.add(x)
    assert tree.root() == id_store.merkle_root(leaves)


# --- 9


def test_url_filters(spark):
    events = spark.createDataFrame([("a", "Bad.com", "block", 10), ("a", "bad.com", "remove", 20), ("a", "bad.com/ok", "allow", 12), ("b", "x.bad.com", "allow", 0)], "list string, pattern string, action string, at int")
    urls = [(1, "http://bad.com/", 9), (2, "http://bad.com/", 10), (3, "https://u:p@www.BAD.com:80/q?x", 19), (4, "http://bad.com/", 20), (5, "http://bad.com/ok/then#f", 15), (6, "http://bad.com/okay", 15), (7, "http://x.bad.com", 15), (8, None, 15), (9, "http://notbad.com", 15), (10, "http://bad.com", None)]
    captures = spark.createDataFrame(urls, "page_id long, url string, fetched_at int")
    for most in (50_000, 0):
        got = {r["page_id"]: (r["kept"], r["n_matches"]) for r in url_filters.evaluate(captures, events, broadcast_rows=most).collect()}
        assert got == {1: (True, 0), 2: (False, 1), 3: (False, 1), 4: (True, 0), 5: (True, 2), 6: (False, 1), 7: (True, 2), 8: (True, 0), 9: (True, 0), 10: (True, 0)}


def test_url_filters_on_repeated_keys(spark):
    events = spark.createDataFrame([("a", "bad.com", "block", 10), ("b", "bad.com/ok", "allow", 10)], "list string, pattern string, action string, at int")
    urls = [(1, "http://bad.com/", 15), (1, "http://bad.com/", 15), (1, "http://bad.com/ok", 15), (1, "http://good.com", 15), (1, "http://bad.com/", 5), (None, "http://bad.com/", 15), (None, None, 15)]
    got = [(r["page_id"], r["url"], r["n_matches"], r["kept"]) for r in url_filters.evaluate(spark.createDataFrame(urls, "page_id long, url string, fetched_at int"), events).collect()]
    want = [(1, "http://bad.com/", 1, False), (1, "http://bad.com/", 1, False), (1, "http://bad.com/ok", 2, True), (1, "http://good.com", 0, True), (1, "http://bad.com/", 0, True), (None, "http://bad.com/", 1, False), (None, None, 0, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_url_filters_on_odd_tables(spark):
    none = spark.createDataFrame([], "list string, pattern string, action string, at int")
    some = spark.createDataFrame([("a", "Bad.com/Path", "block", 1), ("a", "bad.com", "allow", 1)], "list string, pattern string, action string, at int")
    rows = [(1, "http://BAD.com/Path/x" + "y" * 50_000, 2, "p", True), (2, "http://bad.com/path", 2, "p", True)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at int, pattern string, kept boolean")
    assert {r["page_id"]: (r["kept"], r["n_matches"]) for r in url_filters.evaluate(captures, some).collect()} == {1: (False, 2), 2: (True, 1)}
    assert all(r["kept"] for r in url_filters.evaluate(captures, none).collect())
    assert url_filters.evaluate(captures.limit(0), some).collect() == []


# --- 10


def test_language_id(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(table, docs_per_language=60)
    got = language_id.predict(table.withColumn("held_out", language_id.held_out()), model, keep=("doc_id", "lang", "held_out")).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs(spark, ODD), model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[4][0] in model.languages and 0 <= odd[6][1] <= 1


def test_language_without_labels(spark):
    model = language_id.fit(docs(spark, ODD).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.predict(docs(spark, ODD), model).collect()} == {"und"}


def test_pipeline(spark):
    import corpus_pipeline

    rows = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert 0.5 * len(table) < len(rows) <= len(table)
    by_text = {}
    for r in table:
        by_text.setdefault(r["text"], []).append(r["doc_id"])
    for same in by_text.values():  # of exact copies the smallest at most
        assert not rows.intersection(sorted(same)[1:])
