"""Operators of langmill.llm against brute force, on small tables with odd rows."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from langmill.llm import components, edits, jaccard, mixing, neighbours, packing, pii, quality, recompress, suffixes, template, tokens
from langmill.session import collect_staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (None, "a null id"), (9006, "tie tie"), (9006, "tie tie")]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def copies(seed, n=150):
    """Texts that share passages, with near and exact copies."""
    draw = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    base = [draw.choice(pool) for _ in range(1500)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 5)):
            kind = draw.random()
            a = draw.choice([10, 200, draw.randrange(1400)])
            words += base[a : a + draw.choice([5, 19, 20, 21, 60, 150])] if kind < 0.6 else [draw.choice(pool) for _ in range(draw.randint(1, 80))]
            words += ["z"] * draw.choice([5, 20, 45]) if kind > 0.9 else []
        rows.append((i, " ".join(words)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1] + " w1")]


def test_jaccard_components(spark):
    rows = [r for r in copies(1) + ODD if r[0] is not None][:-1]
    for words, percent in ((3, 90), (5, 80)):
        sets = {}
        for i, t in rows:
            found = WORD.findall((t or "").lower())
            sets[i] = {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
        root = {i: i for i in sets}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
        got = jaccard.near_duplicates(table(spark, rows), words=words, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), top(i)) for i, s in sets.items()}


def test_word_windows(spark):
    rows = copies(2)
    seen, want = set(), {}
    for i, t in sorted(rows):
        words = WORD.findall(t)
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            gone |= set(range(k, k + 20)) if window in seen else set()
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(v[1] for v in want.values()) > 1000
    got = recompress.remove_repeats(table(spark, rows + ODD)).collect()
    assert len(got) == len(rows) + len(ODD)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id in want} == want


def test_byte_strings(spark):
    rows = copies(3)
    raw = {i: t.encode() for i, t in rows}
    times = collections.Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    want = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 399):
            if times[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest())
    assert sum(v[1] for v in want.values()) > 1000
    got = suffixes.remove_repeats(table(spark, rows + ODD)).collect()
    assert len(got) == len(rows) + len(ODD)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id in want} == want


def test_byte_strings_around_one_passage_are_cut_into_ranges(spark, monkeypatch):
    draw = random.Random(9)
    letters = "abcdefghij klmnop"
    some = lambda n: "".join(draw.choice(letters) for _ in range(n))
    footer = some(380)
    rows = [(i, some(500) + footer + some(500)) for i in range(300)]
    shared = some(100)
    rows += [(300 + i, some(300) + shared[:50] + footer + shared[50:] + some(300)) for i in range(20)]
    kept = {}
    stage = suffixes.staged
    monkeypatch.setattr(suffixes, "staged", lambda df, name: kept.setdefault(name, stage(df, name)))
    got = suffixes.remove_repeats(table(spark, rows)).collect()
    sizes = [r.n for r in kept["suffixes-runs"].where("range is not null").groupBy("range").agg(F.sum(F.size("counts")).alias("n")).collect()]
    assert sum(sizes) > 300 and max(sizes) < sum(sizes) / 3
    times = collections.Counter(t[k : k + 400] for _, t in rows for k in range(len(t) - 399))
    gone = {i: {k + j for k in range(len(t) - 399) if times[t[k : k + 400]] > 1 for j in range(400)} for i, t in rows}
    assert {r.doc_id: r.n_removed for r in got} == {i: len(g) for i, g in gone.items()} and len(gone[300]) >= 480


def test_byte_strings_do_not_depend_on_the_ranges(spark, monkeypatch):
    rows = copies(5)
    get = lambda: {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(table(spark, rows)).collect()}
    want = get()
    monkeypatch.setattr(suffixes, "RANGE", 2)
    monkeypatch.setattr(suffixes, "OVER", 1)
    assert get() == want and sum(n for n, *_ in want.values()) > 1000


def test_strings_stay_open_only_where_a_border_holds_them():
    draw = random.Random(8)
    some = lambda n: bytes(draw.choice(b"abcdefgh") for _ in range(n))
    passage, length, end = some(300), 400, suffixes._END
    lefts = [some(250) for _ in range(3)]
    left = lambda: draw.choice(lefts)[: draw.randint(100, 250)] + some(draw.randint(0, 20))
    right = lambda: (passage[: draw.randint(90, 300)] + some(300))[: draw.randint(310, 400)]
    keys = sorted({right() + end + left() for _ in range(80)} | {some(390) + end + left() for _ in range(20)})
    same = [0, *(suffixes.shared(a, b) for a, b in zip(keys, keys[1:]))]
    entries = [(k, 1, n) for k, n in zip(keys, same)]
    strings = lambda k: [suffixes._original(k)[0][i : i + length] for i in range(len(suffixes._original(k)[0]) - length + 1)]
    cuts = [20, 50, 80]
    parts = list(zip([0, *cuts], [*cuts, len(keys)]))
    places = collections.defaultdict(set)
    for n, (a, b) in enumerate(parts):
        for k in keys[a:b]:
            left = suffixes._original(k)[1]
            for i, x in enumerate(strings(k)):
                if i <= left <= i + length - suffixes.AHEAD:  # strings that could have chosen this anchor
                    places[(k[: i + length - left], x)].add(n)
    many, marked = 0, collections.defaultdict(lambda: collections.defaultdict(set))
    for n, (a, b) in enumerate(parts):
        low, high = keys[a] if a else b"", keys[b] if b < len(keys) else b""
        _, open_ = suffixes.repeats(entries[a:b], length, low, high)
        given = {strings(k)[i] for k, _, _, at in open_ for i in at.tolist()}
        for k, mark, _, at in open_:
            for i in at.tolist():
                marked[k[: i + length - suffixes._original(k)[1]], strings(k)[i]][n].add(mark)
        needed = {x for (_, x), where in places.items() if n in where and len(where) > 1}
        assert needed <= given
        many += len(given)
    assert all(len(set.union(*where.values())) == 1 for where in marked.values())  # equal strings have equal marks
    assert 0 < many < sum(len(strings(k)) for k in keys) / 2


def test_loser_tree_merges_and_counts():
    draw = random.Random(4)
    keys = [[bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(0, 30))] for _ in range(7)]
    runs = []
    for k in keys:
        ordered = sorted(set(k))
        runs.append(suffixes.Run(*suffixes.front_coded(ordered), [k.count(x) for x in ordered]))
    want = collections.Counter(x for k in keys for x in k)
    got = list(suffixes.merged(runs))
    assert [(k, n) for k, n, _ in got] == sorted(want.items())
    assert all(p == suffixes.shared(a[0], b[0]) for a, b, p in zip(got, got[1:], [g[2] for g in got[1:]]))


def test_encoder_equals_whole_texts():
    import pyarrow as pa

    draw = random.Random(5)
    signs = [*" \n\t\r\u00a0\u3000abé'ß12.,!", "<|endoftext|>", " the", "'ll"]
    texts = ["", None, "  a \n", *("".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(500))]
    plain = Tokenizer.from_file(tokens.default_path())
    got = [ids[x:y].tolist() for _, _, ids, cut in tokens.encoder(tokens.default_path()).column(pa.array(texts, pa.string())) for x, y in zip(cut[:-1], cut[1:])]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(spark):
    rows = [(i, t, f"s{i % 3}" if i and i % 5 else None) for i, t in copies(6, 60) + ODD]
    plain = Tokenizer.from_file(tokens.default_path())
    got = packing.pack(table(spark, rows, "doc_id long, text string, source string")).collect()
    ids = collections.defaultdict(list)
    for i, t, _ in rows:
        ids[i].append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    for r in got:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        total = sum(n for _, n in pieces)
        assert total <= 1024 and total & (total - 1) == 0


def test_edits_equal_full_encoding(spark):
    from pyspark.sql import functions as F

    docs = table(spark, copies(7, 40) + ODD).withColumn("edits", edits.drawn_edits(F.col("text"), F.col("doc_id")))
    plain = Tokenizer.from_file(tokens.default_path())
    want = collections.Counter()
    for r in docs.collect():
        text, before, n = r.text or "", len(plain.encode(r.text or "").ids), 0
        for e in r.edits:
            if None not in (e.start, e.length, e.text):
                text, n = text[: e.start] + e.text + text[e.start + e.length :], n + 1
        want[r.doc_id, before, n, len(plain.encode(text).ids), len(text)] += 1
    got = edits.counts(edits.trees(docs, width=32, edits_col="edits")).collect()
    assert collections.Counter((r.doc_id, r.n_tokens_before, r.n_edits, r.n_tokens, r.n_chars) for r in got) == want


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}" if i % 4 else None) for i in range(4000)]
    result = mixing.mix(table(spark, rows, "doc_id long, text string, source string"))
    taken = collections.Counter()
    for r in mixing.with_sources(result).collect():
        assert r.taken <= 2 * r.size and r.size == r.doc_id % 7
        taken[f"s{r.doc_id % 4}" if r.doc_id % 4 else None] += r.taken
    for key, (size, target) in result.sources.items():
        assert target <= 2 * size and abs(taken[key[1:] if key else None] - target) <= 7
    assert mixing.mix(table(spark, [], "doc_id long, text string, source string")).docs.count() == 0


def test_route_is_cheapest():
    flows = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 10, "b": 14}, (1, 3))
    assert flows[("a", "b"), "b"] >= 10 and sum(n for (_, s), n in flows.items() if s == "b") == 14
    assert sum(flows.values()) == 24


def test_surrogates(spark):
    rows = [(1, "Mr. John Smith wrote to a.b@x.org and paid 4111 1111 1111 1111 from DE89 3704 0044 0532 0130 00"), (2, "Mrs Anna Weber, ip 10.2.33.255; a.b@x.org"), *ODD]
    out, mapping = pii.surrogates(table(spark, rows))
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got[1]) > 0 and not any(x in got[1] + got[2] for x in ("John", "Smith", "a.b@x.org", "4111", "10.2.33.255", "Anna", "Weber", "DE89"))
    assert got[1].split(" wrote to ")[1].split()[0] == got[2].split("; ")[1] and got[9001] is None and got[9004] == "one"
    made = mapping.collect()
    assert len({r.surrogate for r in made}) == len(made) and not {r.surrogate for r in made} & {r.value for r in made}
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1])[0].replace(" ", "")
    assert sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(card)) % 10 == 0


def test_quality_statistics(spark):
    rows = copies(8, 60) + [(500, "# a\n# a\n\n# a x"), *ODD]
    model = quality.fit(table(spark, rows), table(spark, [(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int"), buckets=1 << 10)
    assert quality.keep(table(spark, rows), model).count() == quality.score(table(spark, rows), model).where("kept").count()
    texts = collections.Counter()
    for i, t in rows:
        words = WORD.findall(t or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = collections.Counter(grams)
        again = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        texts[i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again)] += 1
    got = quality.score(table(spark, rows), model).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts


def test_nearest(spark):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((400, 8)) * draw.uniform(0.5, 2, (400, 1))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [1.0])]
    got = neighbours.nearest(table(spark, rows + odd, "vec_id long, embedding array<float>")).collect()
    found = collections.defaultdict(dict)
    for r in got:
        found[r.query_id][r["rank"]] = r.vec_id
    exact = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 400, 20):
        score = exact @ exact[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -np.round(score, 9)))[:20]
        hits += len(set(best.tolist()) & set(found[q].values()))
    assert set(found) == set(range(0, 400, 20)) and hits >= 0.9 * 400


def test_pages(spark):
    page = "<html><body><nav><a>Home</a></nav><div class='ad'>buy</div><article><h1>T{0}</h1><p><b>One &amp; {0}<br><p>two<div class='comments'>c</div></article><footer>f</footer></body></html>"
    rows = [(i, "http://h/a", page.format(i)) for i in range(6)] + [(7, None, None), (8, "bad[", ""), (9, "http://h/b", "<p>no article")]
    got = {r.page_id: r.text for r in template.main_text(table(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 One & 3 two" and got[7] == got[8] == "" and got[9] == "no article" and len(got) == 9


def test_template_of_a_host_is_nested(spark):
    """Classes stand in the gaps of others, a token has a role for each gap, and the order of a class must hold on all pages."""
    def page(i):
        items = "".join(f"<li><i>by</i><a>n{i}-{k}</a></li>" for k in range(2 + i % 3))
        tail = "<em>p</em><u>q</u>" if i % 2 else "<u>q</u><em>p</em>"
        return (f"<html><body><div class='top'><ul>{items}</ul></div><div class='low'><ul><li><i>by</i><a>m{i}</a></li></ul></div>"
                f"<section class='text'><h2>T{i}</h2><div class='note'>Subscribe now</div><p>body {i}</p>{tail}</section></body></html>")

    pages = table(spark, [("h", page(i)) for i in range(9)] + [("h", page(0))] * 5 + [("k", page(i)) for i in (0, 0, 0)], "host string, html string")
    got = {r.host: r for r in template.deduce(pages).collect()}
    assert got["k"].classes is None  # copies of one page are no template
    classes = json.loads(got["h"].classes)
    root = [c for c in classes if c["gap"] == 0]
    gaps = {template._gap(root[0]["class"], k): k for k in range(1, len(root[0]["keys"]))}
    inner = [c for c in classes if c["gap"] in gaps]
    tag = lambda *path: template._key("<" + "".join(f"/{x}" for x in path))
    top = ["html", "body", "div.top", "ul"]
    assert len(root) == 1 and root[0]["keys"][:4] == [tag(*top[: k + 1]) for k in range(4)]
    assert [c["keys"][:2] for c in inner] == [[tag(*top, "li"), tag(*top, "li", "i")]] and gaps[inner[0]["gap"]] == 4
    assert tag("html", "body", "section.text", "em") not in {k for c in classes for k in c["keys"]}  # its order changes


def test_text_of_the_template_is_left_out_of_articles(spark):
    page = "<html><body><article><h1>T{0}</h1><div class='note'>Subscribe now</div><p>a {0}</p><p>All rights</p><p>b {1}</p></article></body></html>"
    rows = [(i, "http://h/a", page.format(i, "x" * (i % 4))) for i in range(6)]
    rows += [(i, "http://k/a", "<html><body><article><h1>same</h1></article></body></html>") for i in range(6, 10)]
    got = {r.page_id: r.text for r in template.main_text(table(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 a 3 All rights b xxx" and got[4] == "T4 a 4 All rights b"
    assert got[7] == "same"


@pytest.mark.parametrize("schema", ["doc_id long, text string, source string, _row int, id string, n long"])
def test_empty_and_clashing_columns(spark, schema):
    for rows in ([], [(1, "a b c", "s", 5, "x", 3)]):
        docs = table(spark, rows, schema)
        for out in (
            jaccard.near_duplicates(docs), recompress.remove_repeats(docs), suffixes.remove_repeats(docs), packing.pack(docs),
            edits.trees(docs), mixing.mix(docs).docs, pii.surrogates(docs)[0].toDF(*"abcdefg"),
        ):
            assert out.count() == len(rows)


def test_entities_begin_where_their_looks_behind_allow(spark):
    cases = {
        "token=abcdefghijklmno": ["abcdefghijklmno"],
        "api_key: 'ABCDEF123456789'": ["ABCDEF123456789"],
        "tokens abcdefghijklmno": [],
        "Dear Mr. Smith, Mrs Élan Roux; xMr Smith éAnna Smith": ["Smith", "Élan Roux"],
        "9Anna Smith _Eva Lang": ["Anna Smith", "Eva Lang"],
        "a@b.co x+a@b.com é10.1.2.3 v10.1.2.3": ["a@b.co", "x+a@b.com", "10.1.2.3"],
        "é0123456789abcdef0123456789abcdef g0123456789abcdef0123456789abcdef": ["0123456789abcdef0123456789abcdef"],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    found = rows.select("text", F.regexp_extract_all("text", F.lit(pii.ANY), F.lit(0)).alias("found")).collect()
    assert {r["text"]: r["found"] for r in found} == cases


def test_mixing_stage_does_not_follow_the_order_of_rows(spark):
    rows = [(i, "word " * (1 + i % 7), f"s{i % 3}") for i in range(200)] + [(None, None, None), (201, "", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    orders = docs.repartition(1), docs.orderBy(F.desc("doc_id")).repartition(3, "source")
    one, two = (sorted(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, d, "").collect()) for d in orders)
    assert one == two and one


def test_compressed_addresses_and_academic_titles(spark):
    rows = [(1, "from 2001:db8::1 and ::ffff:10.1.2.3, fe80::A1 to ::1; Dr. Miller met Prof. Dr. Weber, not :: or 10:30"), (2, "at 12:30:15 x")]
    out, made = pii.surrogates(table(spark, rows))
    got = {r.doc_id: (r.text, r.n_entities) for r in out.collect()}
    shape = r"from [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f] and ::[0-9a-f]{4}:\d\d\.\d\.\d\.\d, [0-9a-f]{4}::[A-F0-9a-f]{2} to ::[0-9a-f]+; Dr\. \w+ met Prof\. Dr\. \w+, not :: or 10:30"
    assert re.fullmatch(shape, got[1][0]) and got[1][1] == 6 and got[2] == ("at 12:30:15 x", 0)
    assert {r.value for r in made.collect()} == {"2001:db8::1", "::ffff:10.1.2.3", "fe80::A1", "::1", "Miller", "Weber"}


def test_jaccard_buckets_of_linked_sets_meet():
    """Sets that link share a bucket name that one of them has for its own size, whatever their sizes."""
    draw = np.random.default_rng(5)
    for percent in (50, 80, 90):
        for n in (5, 9, 10, 11, 40, 77, 300, 2500):
            for _ in range(12):
                one = draw.integers(0, 1 << 63, n).astype(np.uint64)
                lost = int(draw.integers(0, n - -(-percent * n // 100) + 1))
                more = 100 * (n - lost) // percent - n  # as many as the link allows
                two = np.concatenate((one[lost:], draw.integers(0, 1 << 63, more).astype(np.uint64)))
                assert 100 * (n - lost) >= percent * (n + more)
                if 100 * min(n, len(two)) < percent * (min(n, len(two)) + 1):
                    continue
                sizes = np.array([n, len(two)])
                names = []
                for above in (0, 1):
                    name, cut = jaccard._contents(np.concatenate((one, two)), np.repeat([0, 1], sizes), sizes, percent, above)
                    names.append([set(name[cut[i] : cut[i + 1]]) for i in (0, 1)])
                (own_one, own_two), (next_one, next_two) = names
                assert own_one & own_two or own_one & next_two or next_one & own_two


def test_jaccard_pairs_do_not_grow_with_common_shingles(spark):
    """Long texts that share a rare passage, and nothing else, are no candidates of one another."""
    draw = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(6))
    rows = [(i, " ".join([passage] + [f"w{draw.randrange(10**6)}" for _ in range(1500)])) for i in range(40)]
    docs = table(spark, rows).withColumnsRenamed({"doc_id": "id"})
    lists = jaccard.index(docs, 3, 90).select("node", F.explode(F.concat("own", "next")).alias("bucket"))
    assert lists.groupBy("bucket").agg(F.countDistinct("node").alias("n")).where("n > 1").count() == 0


def test_jaccard_probes_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Near copies among unlike texts of the same base: each is compared with a few, and a pair comes from one list only."""
    draw = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(90)]
    for i in range(90, 250):
        words = list(base)
        for k in draw.sample(range(100), 4):
            words[k] = f"y{i}-{k}"
        rows.append((i, " ".join(words)))
    probed, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *more: probed.append(verified(pairs, *more)) or probed[-1])
    got = jaccard.near_duplicates(table(spark, rows), words=3, percent=90).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i if i >= 90 else 0 for i, _ in rows}
    assert sum(p.count() for p in probed) < 4 * len(rows)


def test_jaccard_lists_hold_a_set_once(spark):
    """Copies of a text add nothing to the lists of a task, and lists of one set alone never leave the group that orders them."""
    copies_, other = [(i, " ".join(f"w{k}" for k in range(80))) for i in range(300)], [(300, " ".join(f"v{k}" for k in range(80)))]
    docs = table(spark, copies_ + other).withColumnsRenamed({"doc_id": "id"}).coalesce(1)
    lists = jaccard.index(docs, 3, 90)
    assert lists.count() == lists.select("node").distinct().count() == 2
    met = jaccard._dealt(lists, 5).groupBy("part").applyInArrow(jaccard._met, "bucket long, node long, own boolean")
    assert met.count() == 0


def test_jaccard_lists_take_one_worker_a_task(spark, monkeypatch):
    """Lists are made and dealt by the same Python worker, and are those of the two steps one after the other."""
    plans, stage = {}, jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and stage(df, name))
    docs = table(spark, copies(1)).withColumnsRenamed({"doc_id": "id"}).coalesce(1)
    jaccard.near_duplicates(docs, id_col="id").count()
    assert plans["jaccard-shared"].count("MapInArrow") == 1
    got, want = (sorted(df.collect()) for df in (jaccard._dealt_index(docs, 5, 80, 7), jaccard._dealt(jaccard.index(docs, 5, 80), 7)))
    assert got == want and got


def test_jaccard_workers_hold_little():
    """Neither a batch of very short texts nor a large one of long texts needs more than a few small arrays."""
    short, long = pa.array([f"a{i} b c d e f" for i in range(10_000)]), pa.array([" ".join(f"w{(i * k) % 997}" for k in range(2_000)) for i in range(400)])
    most = []
    for texts in (short, long):
        tracemalloc.start()
        for a, b, gram, cut in jaccard.shingle_sets(texts, 5):
            owner = np.repeat(np.arange(b - a), np.diff(cut))
            bits = np.stack([p.to_numpy() for p in jaccard._parities(gram, owner, b - a)], axis=1)
            odd = np.unpackbits(bits.view(np.uint8).reshape(b - a, -1), axis=1).sum(axis=1)
            assert (odd <= np.diff(cut)).all() and (odd % 2 == np.diff(cut) % 2).all()
        most.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    assert max(most) < 64, most


def test_quality_uses_all_labels(spark):
    """Labels without documents change nothing, however many there are; the threshold is that of a plain search."""
    rows = [(i * 100, f"{'good fine' if i % 3 else 'bad junk'} " + " ".join(f"w{(i * k) % 97}" for k in range(60 + i % 7))) for i in range(200)]
    own = spark.createDataFrame([(i, int(i // 100 % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    others = spark.range(21_000).selectExpr("id * 100 + 1 as doc_id", "1 as quality", "0 as toxic")
    docs = table(spark, rows)
    few, many = quality.fit(docs, own, buckets=1 << 10), quality.fit(docs, own.union(others), buckets=1 << 10)
    assert (few.ratio == many.ratio).all() and few.threshold == many.threshold
    draw = random.Random(4)
    scores = [(draw.random() < 0.4 + v / 20, v / 8) for v in (draw.randrange(12) for _ in range(300))]
    good, bad = [v for t, v in scores if t], [v for t, v in scores if not t]
    edges = sorted({v for _, v in scores})
    edges = [float("-inf"), *((a + b) / 2 for a, b in zip(edges, edges[1:])), float("inf")]
    cost = lambda e: 5 * sum(v < e for v in good) / len(good) + sum(v >= e for v in bad) / len(bad)
    assert quality._threshold(table(spark, scores, "trusted boolean, value double")) == min(edges, key=lambda e: (round(cost(e), 9), e))
    assert quality._threshold(table(spark, [(True, 1.0)], "trusted boolean, value double")) == float("-inf")


def test_a_search_writes_every_scored_node_once(spark):
    """Rounds add what they have scored; they do not write or join again what earlier rounds had."""
    draw = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, draw.standard_normal(6).tolist()) for i in range(700)], "vec_id long, embedding array<double>")
    nodes = neighbours.nodes_of(neighbours.usable(vectors, "vec_id", "embedding"), 21)
    asked = nodes.where("node < 5").select(F.col("node").alias("query_id"), F.col("v").alias("q"), F.col("node").alias("at"))
    ring = nodes.select("node", F.explode(F.transform(F.array(F.lit(1), F.lit(7)), lambda k: (F.col("node") + k) % 700)).alias("to"), F.lit(0.0).alias("score"))
    with collect_staged() as paths:
        found = neighbours.search(asked, nodes, ring)
    rows = [spark.read.parquet(p).count() for p in paths if "/neighbours-seen-" in p]
    once = spark.read.parquet(*[p for p in paths if "/neighbours-seen-" in p]).select("query_id", "node").distinct().count()
    assert len(rows) > 1 and sum(rows) == once and found.groupBy("query_id").count().where(f"count != {neighbours.BEAM}").count() == 0


def test_jaccard_members_pair_with_leaders_that_may_be_alike_only(spark):
    """Sets that share a list and little else make no pair with its leaders; near copies make one with each of the few at most."""
    draw = random.Random(12)
    fields = "bucket long, node long, own boolean, n long, " + ", ".join(f"{c} long" for c in jaccard._COARSE) + ", root long"
    unlike = [(1, i, True, 100, *(draw.randrange(-(1 << 63), 1 << 63) for _ in jaccard._COARSE), i) for i in range(300)]
    near = [(2, 1000 + i, True, 100, 1 << i % 3, 5, 6, 7, 1000 + i) for i in range(300)]
    pairs = jaccard._led(spark.createDataFrame(unlike + near, fields), 0, 90).collect()
    assert len({p.a for p in pairs}) == 300 and len(pairs) == jaccard.LEADERS * 299 and all(p.a >= 1000 and p.b >= 1000 for p in pairs)


def test_jaccard_coarse_parities_differ_in_no_more_bits_than_sets(spark):
    draw = np.random.default_rng(13)
    for n, lost in ((5, 1), (100, 9), (900, 60)):
        one = draw.integers(0, 1 << 63, n).astype(np.uint64)
        two = np.concatenate((one[lost:], draw.integers(0, 1 << 63, lost).astype(np.uint64)))
        bits = jaccard._parities(np.concatenate((one, two)), np.repeat([0, 1], [n, n]), 2)
        a, b = (dict(zip(jaccard._PARITIES, (c[i].as_py() for c in bits))) for i in (0, 1))
        one_row = spark.createDataFrame([a, b], ", ".join(f"{c} long" for c in jaccard._PARITIES)).select(*jaccard._coarse()).collect()
        assert 0 < sum((x ^ y).bit_count() for x, y in zip(*([v % (1 << 64) for v in r] for r in one_row))) <= 2 * lost


def test_components_write_little(spark, monkeypatch):
    """Paths, stars and random links: every node but the smallest of its component gets that one, in a few narrow writes."""
    draw = random.Random(14)
    links = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(300)] + [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(330)]
    order = draw.sample(range(3000, 3500), 500)
    links += [*zip(order, order[1:]), (5000, 5000)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    written, stage = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or stage(df, name))
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(r for r in map(tuple, got) if r[0] != r[1]) == sorted((i, top(i)) for i in root if top(i) != i)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert sum(written) < 20, written
