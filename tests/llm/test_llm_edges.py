"""Nulls, empty and long texts, ties, repeats, empty tables and clashing column names, per
operator; exactness of the building blocks."""

import os
import re
import sys

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quire.llm import (bpe, common, components, decontaminate, exact_dedup,  # noqa: E402
                       extraction, language, mixing, near_join, pii, tokens, toxicity, warc)
from quire.llm.html import main_text  # noqa: E402
from quire.session import checkpoint_root  # noqa: E402

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, row string, id string,"
        " key string, run long, size long, kept boolean, salt int, uid long")
EXTRA = ("r", "i", "k", 7, 8, True, 9, 10)


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, *EXTRA) for r in rows], DOCS)


def passage(n, seed=0):
    return " ".join(f"w{seed}x{i}" for i in range(n))


LONG = passage(60_000, 3)
ROWS = [
    (1, "Alpha  beta\tgamma", "en", "a"), (2, "alpha beta gamma", "en", "a"),
    (3, "Alpha beta gamma", "en", None), (4, None, None, None), (5, "", "en", ""),
    (6, " \t\n", "de", "b"), (7, passage(40), "en", "b"), (7, passage(40), "en", "b"),
    (8, passage(40) + " tail", "en", "c"), (9, LONG, "en", "a"), (None, passage(40), None, "c"),
    (10, "é ü", "fr", "a"), (11, "one", "en", "c"),
]


@pytest.fixture(scope="module")
def some(spark):
    return docs(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_exact_dedup_edges(some, none):
    got = exact_dedup.exact_groups(some).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.kept): r for r in got}
    # row 1 has one code point more than row 3
    assert by[1, True].group_size == 2 and by[3, False].keep_id == 1
    assert {r.keep_id for r in got if r.doc_id in (4, 5, 6)} == {6}
    copies = [r for r in got if r.keep_id == 7]
    assert [r.group_size for r in copies] == [3] * 3 and sum(r.kept for r in copies) == 1
    kept = exact_dedup.keep_one(some)
    assert kept.columns == some.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7, 8, 9, 10, 11]
    assert exact_dedup.exact_groups(none).count() == exact_dedup.keep_one(none).count() == 0


def test_mixing_edges(some, none):
    got = mixing.mix_sources(some).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    target = {r.source: r.target for r in got}
    assert set(target) == {"", "a", "b", "c", None}
    size = {r.source: r.source_size for r in got}
    assert target[""] == 0 and all(t <= 3 * size[s] + 1e-6 for s, t in target.items())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    again = mixing.mix_sources(some.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(none).count() == 0


def test_apportionment_equals_seat_by_seat(spark):
    rng = np.random.default_rng(5)
    for _ in range(6):
        votes = [int(x) for x in rng.integers(1, 1000, int(rng.integers(2, 9)))]
        seats = int(rng.integers(0, 60))
        df = spark.createDataFrame([(i, v, 1 << 30) for i, v in enumerate(votes)],
                                   "i int, v long, most long")
        got = {r.i: r.won for r in mixing._seats(df, [], "v", F.lit(seats), "most", ["i"]).collect()}
        want = dict.fromkeys(range(len(votes)), 0)
        for _ in range(seats):
            want[max(want, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert got == want


def test_near_join_edges(some, none):
    got = near_join.near_duplicates(some).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: (r.class_id, r.n_links) for r in got}
    assert by[1] == by[2] == by[3] == (1, 2)
    assert by[4] == (4, 0) and by[5] == (5, 0) and by[6] == (6, 0)
    assert by[7] == (7, 3) and by[8] == (7, 3) and by[None] == (7, 3)
    assert by[9] == (9, 0) and by[11] == (11, 0)
    kept = near_join.keep_one(some)
    assert kept.columns == some.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 9, 10, 11}
    assert near_join.near_duplicates(none).count() == 0


def test_near_join_of_a_dense_group_finds_every_link(spark, monkeypatch):
    """A group larger than the bucket limit and than a block, all pairs checked."""
    monkeypatch.setattr(near_join, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = passage(80).split()
    rows = []
    for i in range(70):
        w = list(base)
        for j in rng.integers(0, 80, int(rng.integers(0, 3))):
            w[j] = f"z{i}q{j}"
        rows.append((i, " ".join(w), "en", "s"))
    sets = {i: {tuple(w[j:j + 5]) for j in range(76)} for i, t, _, _ in rows for w in [t.split()]}
    want = {i: sum(len(a & b) / len(a | b) >= 0.8 for j, b in sets.items() if j != i)
            for i, a in sets.items()}
    got = near_join.near_duplicates(docs(spark, rows), bucket_limit=8).collect()
    assert {r.doc_id: r.n_links for r in got} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = {r.node: r.label for r in components.components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(1, 31), 0) | dict.fromkeys(range(101, 140), 100)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontaminate_edges(spark, some, none):
    items = spark.createDataFrame(
        [("b", passage(12)), ("a", "W0X3, w0x4!"), ("c", ""), ("d", None), (None, "nowhere at all"),
         ("e", "É ü")], "item_id string, text string")
    got = decontaminate.contamination(some, items).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[7].n_hit == 12 and by[7]["items"] == ["a", "b"] and by[7].n_words == 40
    assert sum(r.doc_id == 7 for r in got) == 2
    assert not by[4].contaminated and by[4].n_words == by[5].n_words == by[6].n_words == 0
    assert by[10].n_hit == 0        # only A-Z is lower-cased
    assert by[9].n_words == 60_000 and by[9].n_hit == 0
    clean = decontaminate.keep_clean(some, items)
    assert clean.columns == some.columns
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, 5, 6, 9, 10, 11}
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(some, items.limit(0)).collect())


def test_decontaminate_guarantees_spans_of_ten(spark):
    """Every position and length of ten words or more is found, none below."""
    item = passage(30, 5).split()
    rows, want = [], []
    for n in (8, 9, 10, 11, 25):
        for at in (0, 7, 30 - n):
            rows.append((len(rows), f"{passage(6, 8)} {' '.join(item[at:at + n])} {passage(6, 9)}",
                         "en", "s"))
            want.append(min(n, 30 - at) if n >= 10 else 0)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs(spark, rows), bench).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_language_edges(spark, none):
    train = docs(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(
        [("the cat and the dog were in the house with the bird", "en"),
         ("der hund und die katze waren mit dem vogel im haus", "de")] * 20)])
    model = language.fit(train)
    assert sorted(model) == ["de", "en"]
    test = docs(spark, [(1, "the dog and the cat", None, None), (2, "die katze und der hund", None, None),
                        (3, None, "en", None), (4, "12 :-)", "de", None), (None, "", None, None),
                        (6, "the house with the bird " * 5000, "de", "x")])
    by = {r.doc_id: r for r in language.identify(test, model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, None, 6)] == ["en", "de", "und", "und", "und", "en"]
    assert by[3].rejected and by[3].score == 0 and not by[1].rejected and by[1].score > 0.5
    kept = language.keep_identified(test, model)
    assert kept.columns == test.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6}
    assert language.fit(none) == {} and language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(test, {}).collect()} == {"und"}
    alone = {r.doc_id: r for r in language.identify(test, {"en": model["en"]}).collect()}
    assert alone[2].lang_pred == "en" and alone[2].score == 1


def test_dictionaries_take_every_sampled_row_beyond_its_opening(spark, monkeypatch):
    opening = " ".join("abcdefghij"[i % 10] * (1 + i % 7) for i in range(2000))
    word = lambda i: "".join("klmnopqrst"[int(c)] for c in f"{i:03d}")
    rows = [(i, f"{opening} {(word(i) + ' ') * 5000}", "en", "s") for i in range(200)]
    model = language.fit(docs(spark, rows))
    assert len(model["en"]) <= language.DICT_BYTES
    assert sum(word(i).encode() in model["en"] for i in range(200)) >= 100
    boilerplate = sum(model["en"].count(c) for c in b"abcdefghij")
    assert boilerplate < 0.6 * len(model["en"])
    # every sampled row has a piece, whatever the number of languages
    rows = [(i, f"{word(i)} " * 2000, "en", "s") for i in range(200)]
    model = language.fit(docs(spark, rows))
    assert all(word(i).encode() in model["en"] for i in range(200))
    monkeypatch.setattr(language, "MODEL_BYTES", 1 << 17)
    model = language.fit(docs(spark, [(i, t, f"l{i % 50}", s) for i, t, _, s in rows]))
    assert len(model) == 50 and 0 < sum(map(len, model.values())) <= 1 << 17


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


TEXTS = ["", " ", "  a", "a  b", "don't they're we've I'll", "x\n\n\n y  ", "\t\t tab", "1234567 8 99",
         "naïve café ☕☕ 日本語テキスト", "a<|endoftext|>b <|endoftext|>", "foo <|endoftext", "!!'re '''s",
         "a  b \x85c \x1c d", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 70, " \n a \r\n b",
         "it's they'Re 'rest we'veto", "퟿\U0001f600\U0001f469‍\U0001f467 ok"]


def test_prefix_counts_equal_the_library_at_every_prefix():
    path, lib = library()
    count = bpe.PrefixCounts(path)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for t in TEXTS:
        got = count.prefixes(t).tolist()
        assert got == [n(t[:i]) for i in range(len(t) + 1)], t
        assert count.total(t) == n(t)
        for limit in (0, 1, 3, 5, 8):
            fit = max(i for i in range(len(t) + 1) if n(t[:i]) <= limit)
            if n(t) > limit:
                assert count.total_and_fit(t, limit) == (n(t), fit)


def test_token_counts_edges(spark, some, none):
    path, lib = library()
    got = tokens.token_counts(some, path, prefixes=True).collect()
    assert len(got) == len(ROWS)
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in got:
        t = texts[r.doc_id]
        assert r.n_tokens == len(lib.encode(t, add_special_tokens=False).ids)
        assert r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 512)
        assert len(r.prefix_tokens) == len(t) + 1 and r.prefix_tokens[-1] == r.n_tokens
        assert r.prefix_tokens[r.fit_chars] <= 512
    assert tokens.token_counts(none, path).count() == 0


def test_personal_data_edges(spark, some, none):
    text = ("mail a.b@c.de, ip 1.2.3.4 and 1.2.3.999; card 4111 1111 1111 1111 or 4111111111111112;"
            " call +1 (415) 555-2671 x@y a@b.c_d@e.f é@ü.com +12")
    got = pii.find_personal_data(docs(spark, [(1, text, None, None), (2, None, None, None),
                                              (None, "", None, None), (1, text, None, None)]))
    by = [r for r in got.collect()]
    assert len(by) == 4
    want = [("email", "a.b@c.de"), ("email", "a@b.c"), ("email", "_d@e.f"), ("ip", "1.2.3.4"),
            ("card", "4111 1111 1111 1111"), ("phone", "+1 (415) 555-2671")]
    for r in by:
        found = [(e.kind, e.value) for e in r.entities if e.base]
        assert found == (want if r.doc_id == 1 else [])
        assert all(text[e.start:e.end] == e.value for e in r.entities)
    assert pii.find_personal_data(none).count() == 0
    assert all(not r.entities for r in pii.find_personal_data(some).collect())


def test_context_discovers_unseen_identifiers(spark):
    rows = [(i, f"please dial: +1 (415) 555-26{i:02d} now", None, None) for i in range(10)]
    rows += [(10, "please dial: 415 555 2671 now", None, None),      # after a trusted word
             (11, "the sum was 415 555 2671 or so", None, None),     # the same value elsewhere
             (12, "the sum was 416 555 9999 or so", None, None),     # never after a trusted word
             (13, "hotline: 415 555 2671 a hotline: 415 555 2672 hotline: 415 555 2673", None, None),
             (14, "please dial: 415 555 2672 or please dial: 415 555 2673", None, None),
             (15, "hotline: 417 555 0000", None, None)]              # by a pattern found later
    got = {r.doc_id: [(e.kind, e.value) for e in r.entities if not e.base] for r in
           pii.find_personal_data(docs(spark, rows)).collect()}
    assert got[10] == [("phone", "415 555 2671")] == got[11]
    assert got[12] == [] and len(got[13]) == 3 and len(got[14]) == 2
    assert got[15] == [("phone", "417 555 0000")]


def test_long_runs_stay_linear(spark):
    row = "a" * 200_000 + " " + "1" * 200_000 + " " + "." * 100_000 + "+1" + " " * 200_000
    got = pii.find_personal_data(docs(spark, [(1, row, None, None)])).collect()
    assert got[0].entities == []


PAGES = "page_id long, url string, html string, text string, uid long, key string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "k", "d") for r in rows], PAGES)


def test_warc_round_trip(spark):
    big, copy = "<p>é" + "x" * 200, "<p>" + "y" * 300
    rows = [(3, "http://h/3", copy), (1, "http://h/1", big), (2, None, copy), (2, "u\r\nX: 1", copy),
            (4, "http://h/4", None), (5, "http://h/5", ""), (6, "u", "small"), (7, "u", "small"),
            (8, "u", "z" * 3_000_000), (None, "n", copy), (9, "u", "a\r\n\r\nb" * 50)]
    df = pages(spark, rows).repartition(2)
    folder = f"{checkpoint_root(spark)}/warc-test-{os.urandom(6).hex()}"
    index = warc.write_archives(df, folder)
    got = warc.read_archives(index, folder).collect()
    assert len(got) == len(rows)
    full = {i: h or "" for i, _, h in rows}
    for r in got:
        raw = full[r.id].encode()
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == __import__("hashlib").sha256(raw).hexdigest()
        assert r.payload == (full[r.id] if r.record_type == "response" else None)
    revisits = sorted((str(r.id), r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == [("2", 2), ("3", 2), ("None", 2)]
    one = warc.read_archives(index.where("id = 1"), folder).collect()
    assert [r.payload for r in one] == [big]
    empty = warc.write_archives(pages(spark, []), folder + "e")
    assert empty.count() == 0 and warc.read_archives(empty, folder + "e").count() == 0


def test_main_text_rules():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav>
    <div class="cookie-notice">ok?</div><article><h1>Head &amp; more</h1><p>One<b>two</b>
    three<br>four<p>five <i>six</i><script>var x="<p>no</p>"</script>
    <aside>side</aside><div class="ad-slot">buy</div><ul><li>a<li>b</ul>
    <form><input value=">">send</form><section id="comments"><p>first!</p></section></article>
    <div class="sidebar">links</div><footer>&copy;</footer></body></html>"""
    assert main_text(page, set()) == "Head & more Onetwo three four five six a b"
    assert main_text("", set()) == main_text("<p", set()) == main_text("<!-- x", set()) == ""
    assert main_text("plain &lt;text&gt; &#233; &am", set()) == "plain <text> é &am"
    assert main_text("a < b <p>c<", set()) == "a < b c<"
    assert main_text("<main><p>x</p></main><p>y</p>", set()) == "x"


def test_deep_nesting_keeps_the_whole_text(spark):
    n = 5000
    want = " ".join(f"t{i}" for i in range(n))
    rows = [(j, "http://deep.example/", head + "".join(f"<{tag}>t{i} " for i in range(n)))
            for j, (head, tag) in enumerate([("", "font"), ("", "a name=x"), ("", "div"),
                                             ("<article>", "span"), ("<main>", "div")])]
    rows.append((9, "http://deep.example/", "<article>" + "<div>" * n + want))
    got = {r.page_id: r.text for r in extraction.extract_text(pages(spark, rows)).collect()}
    assert got == dict.fromkeys([0, 1, 2, 3, 4, 9], want)


def test_names_inside_an_article_judge_containers_only():
    page = """<article><section id="related-work"><h2 id="how-search-works">How</h2><p class="notice">
    One.</p></section><div class="search-theory">Two.</div><span class="alert">Three.</span>
    <div class="post tag-login">Four.</div><div class="share-buttons">x</div><div role="search">x</div>
    <div id="comments">x</div><ul class="menu"><li>x</ul></article>"""
    assert main_text(page, set()) == "How One. Two. Three. Four."


def test_site_templates_go_and_articles_stay(spark):
    rows = [(i, f"http://one.example/{i}",
             f"<body><div class=q1>Same box on all pages</div><div><p>Own text {i}</p>"
             "<p>Shared last line.</p></div></body>") for i in range(12)]
    rows += [(100, "http://two.example/1", rows[0][2]), (101, None, None), (102, "", "<b>x"),
             (103, "http://three.example/a", "<article><p>Shared</p></article>" * 2)]
    rows += [(200 + i, f"HTTP://Four.example:80/{i}", f"<article><h1>Same</h1><p>Same all.</p><p>{i}</p>"
              "<div>Box</div></article>") for i in range(9)]
    # copies of one page support no template
    rows += [(300 + i, f"http://five.example/{i}", "<article><p>Same all.</p><div>Box</div></article>")
             for i in range(9)]
    got = {r.page_id: r.text for r in extraction.extract_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(12))
    assert got[100] == "Same box on all pages Own text 0 Shared last line."
    assert got[101] == "" and got[102] == "x" and got[103] == "Shared Shared"
    assert all(got[200 + i] == f"Same Same all. {i}" for i in range(9))
    assert all(got[300 + i] == "Same all. Box" for i in range(9))
    assert extraction.extract_text(pages(spark, [])).count() == 0


def test_copies_of_a_page_support_no_template(spark, tmp_path):
    """A print view, query strings and mirrors of an article leave its own containers alone."""
    article = ("<article><div class=entry><p>Story {0}.</p><ul><li>Point {0}</ul><table><td>Cell {0}"
               "</table></div>{1}</article>")
    plain = "<body><div><p>Plain story.</p><p>Second.</p></div></body>"
    rows = [(i, f"http://one.example/a?{i}", article.format("A", "")) for i in range(8)]
    rows += [(10 + i, None, plain) for i in range(8)]
    rows += [(20 + i, f"http://two.example/{i % 6}", article.format(i % 6, "<div>Box</div>"))
             for i in range(12)]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in extraction.op6_html_text(spark, str(tmp_path)).collect()}
    assert all(got[i] == "Story A. Point A Cell A" for i in range(8))
    assert all(got[10 + i] == "Plain story. Second." for i in range(8))
    # six different pages, each twice: the box is on all of them
    assert all(got[20 + i] == "Story {0}. Point {0} Cell {0}".format(i % 6) for i in range(12))


def test_toxicity_edges(spark, some, none):
    rude = ["you idiot moron", "what a stupid idiot", "moron and idiot here", "stupid moron you"]
    rows = [(i, f"{passage(20, i)} {'nice day' if i % 5 else rude[i // 5 % 4]}", "en", "s")
            for i in range(200)]
    marks = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    marks += [(999, 1, 1), (None, 1, 1), (1, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    test = docs(spark, [(1, "such an idiot moron", None, None), (2, passage(50, 999), None, None),
                        (3, None, None, None), (4, "", None, None), (None, "nice", None, None)])
    by = {r.doc_id: r for r in toxicity.severity(test, model).collect()}
    assert by[1].toxic and not any(by[i].toxic for i in (2, 3, 4, None))
    assert by[1].severity > by[2].severity and by[3].severity == by[4].severity
    assert toxicity.severity(none, model).count() == 0
    nothing = toxicity.fit(none, labels)
    assert nothing.weights == () and not any(
        r.toxic for r in toxicity.severity(some, nothing).collect())


def test_severity_grows_with_shared_weights():
    grade = toxicity.grades(np.array([False, True, True, True]), np.array([9.0, 0.1, 0.2, 0.3]))
    assert grade.tolist() == [0, 1, 1, 2]
    rows = np.array([0, 1, 2, 2, 3, 3, 3])
    cols = np.array([0, 1, 1, 2, 1, 2, 3])
    w, cut = toxicity._fit(rows, cols, np.array([0, 1, 1, 2]), 4)
    assert cut[0] < cut[1] and w[1] > w[0]


def test_words_follow_the_pattern():
    import pyarrow as pa

    from quire.llm.words import words_of
    texts = ["Aé-b C3", "", None, "x", "ZZ\x7f_q", "ab", "日本 語"]
    for w in words_of(pa.array(texts)):
        for i in range(w.lo, w.hi):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or "")
            want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            a, z = w.first[i - w.lo], w.first[i - w.lo + 1]
            assert [w.text(j, j + 1).decode() for j in range(a, z)] == want


def _talk(i, words):
    return " ".join(words[(i * 7 + j * j) % len(words)] for j in range(40))


EN = [f"the{c}tion{d}ing" for c in "abcdefgh" for d in "rstuvw"]
FR = [f"le{c}eux{d}ment" for c in "ijklmnop" for d in "aeiouy"]


def test_language_learns_from_null_and_repeated_ids(spark):
    good = [(i, _talk(i, EN), "en", "a") for i in range(400)]
    odd = [(None, _talk(i, FR), "fr", "a") for i in range(300)]     # ids unknown
    assert set(language.fit(docs(spark, good + odd))) == {"en", "fr"}
    empty = [(i, None, "fr", "a") for i in range(4000)] + [
        (i, "12 34", "fr", "a") for i in range(4000, 5000)] + [
        (i, _talk(i, FR), "fr", "a") for i in range(5000, 5003)]
    assert len(language.fit(docs(spark, good + empty))["fr"]) > 500
    one = [(77, _talk(i % 900, FR), "fr", "a") for i in range(2000)]  # one id, many texts
    model = language.fit(docs(spark, good + one))
    assert len(model["fr"]) > 20_000
    same = [(77, _talk(1, FR), "fr", "a")] * 10_000 + [(i, _talk(i, FR), "fr", "a") for i in range(90)]
    model = language.fit(docs(spark, good + same).repartition(4))
    assert len(model["fr"]) > 10_000
    got = language.identify(docs(spark, [(1, _talk(5, EN), None, "a"), (2, _talk(6, FR), None, "a")]),
                            model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "en", 2: "fr"}


def test_sample_rows_is_bounded_and_counts_equal_rows_once(spark):
    rows = spark.range(20_000).selectExpr("id % 2 = 0 AS g", "if(id < 9000, 1, id) AS id")
    got = common.sample_rows(rows, "g", ["id"], {True: 100, False: 50}).collect()
    assert sorted(r.nr for r in got if r.g) == list(range(1, 101))
    assert sorted(r.nr for r in got if not r.g) == list(range(1, 51))
    assert len({(r.g, r.id) for r in got}) == 150
    assert common.sample_rows(rows.where("id < 0"), "g", ["id"], 5).count() == 0


def test_toxicity_sample_keeps_its_bound_where_an_id_repeats(spark):
    rows = [(7, f"text {i}", "en", "a") for i in range(5000)] + [
        (i, "good words here", "en", "a") for i in range(100, 300)]
    labels = spark.createDataFrame([(7, 1), (7, 1), (None, 1)] + [(i, 0) for i in range(100, 300)],
                                   "id long, flag int").selectExpr("id", "flag > 0 AS toxic")
    sample = toxicity._sample(docs(spark, rows).select(F.col("doc_id").alias("id"), "text"), labels)
    assert sample.count() == 201


def test_toxicity_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(all_docs, labels.where(~held))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = (toxicity.severity(all_docs, model).join(labels.where(held).selectExpr(
        "doc_id", "toxic AS label"), "doc_id").collect())
    bad = [r for r in got if r.label]
    good = [r for r in got if not r.label]
    assert len(bad) > 20 and sum(r.toxic for r in bad) >= 0.8 * len(bad)   # some labels are wrong
    assert sum(r.toxic for r in good) <= 0.01 * len(good)


@pytest.mark.parametrize("page,text", [
    ('<div class="layout has-sidebar"><p>Real text</p></div>', "Real text"),
    ('<div class="post share-enabled"><p>Real text</p></div>', "Real text"),
    ('<article><p>A</p></article><div class="post-sidebar">B</div>', "A"),
    ("<main><p>Real body of the page</p><section><article>teaser</article></section></main>",
     "Real body of the page teaser"),
    ("<body><p>Real body of the page</p><section><article>teaser</article></section></body>",
     "Real body of the page teaser"),
    ("<main><h2>T</h2><article>The longer article</article></main>", "The longer article"),
    ("<section id=search-algorithms><p>Found</p></section>", "Found"),
    ("<section id=search><p>Box</p></section><p>Found</p>", "Found"),
    ("<p title=it's>hello</p><p>don't</p>", "hello don't"),
    ('<p title="a>b" x=\'c>d\'>hello</p>', "hello"),
    ("<nav id=a/><a href=/x>menu</a></nav><p>text</p>", "text"),
    ("<p>a <svg/>b</p>", "a b"), ("<p>a<svg><path d='M0'/></svg>b</p>", "ab"),
    ('<div class="content-sidebar"><p>Text</p></div><div class="sidebar-inner">x</div>', "Text"),
    ('<article><div class="share-buttons">x</div><p id="share">y</p></article>', "y"),
])
def test_main_text_of_ordinary_markup(page, text):
    assert main_text(page, set()) == text


def test_unmatched_end_tags_cost_no_search():
    import time

    n = 20_000
    begin = time.time()
    assert main_text("<div>" * n + "x" + "</span>" * n + "<b>" * n + "<p>" * 9, set()) == "x"
    assert main_text("<p>long " + "words and <i>more</i> " * 200_000, set()).count("more") == 200_000
    assert time.time() - begin < 20


def test_a_box_on_few_pages_of_a_large_host_goes_and_no_article_text_does(spark):
    def page(i):
        box = "<div><p>Join our list</p></div>" if i % 100 == 0 else ""
        return (f"<body><article><p>Text {i}.</p><p>Shared paragraph.</p>{box}<p>End {i}.</p>"
                "</article></body>")
    rows = [(i, f"http://big.example/{i}", page(i)) for i in range(1200)]
    got = {r.page_id: r.text for r in extraction.extract_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"Text {i}. Shared paragraph. End {i}." for i in range(1200))


# a third of all rows is one row, or has no id
HOT = [(i, passage(40, i), "en", "abc"[i % 3]) for i in range(700)] + [
    (5, passage(40, 9999), "en", "a")] * 300 + [(None, passage(30, 7000 + i % 7), "fr", None)
                                               for i in range(300)]


def test_hot_rows_in_dedup_mixing_and_decontamination(spark):
    df = docs(spark, HOT).repartition(5)
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(HOT) and sum(r.kept for r in got) == 708
    assert {r.group_size for r in got if r.doc_id == 5} == {1, 300}
    assert sum(r.kept for r in got if r.doc_id is None) == 7
    kept = exact_dedup.keep_one(df).collect()
    assert len(kept) == 708 and len({r.text for r in kept}) == 708
    mixed = mixing.mix_sources(df).collect()
    assert len(mixed) == len(HOT)
    for source in "abc":
        rows = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) < 0.05 * rows[0].target + 64
    hot = [r.taken for r in mixed if r.doc_id == 5 and r["size"] == 40]
    assert all(0 <= t <= 120 for t in hot) and len(hot) == 301
    bench = spark.createDataFrame([("x", passage(40, 9999)), ("y", passage(10, 7003))],
                                  "item_id string, text string")
    found = decontaminate.contamination(df, bench).collect()
    assert len(found) == len(HOT)
    assert sum(r.contaminated for r in found) == 300 + sum(
        1 for r in HOT if r[0] is None and "w7003x" in r[1])


def test_hot_rows_in_archives_and_pages(spark, tmp_path):
    same = "<article><p>" + passage(40) + "</p></article>"
    rows = [(i, f"http://a.example/{i}", f"<p>{passage(30, i)}</p>") for i in range(200)]
    rows += [(7, "http://b.example/", same)] * 150 + [(None, f"http://c.example/{i}", same)
                                                     for i in range(150)]
    df = pages(spark, rows).repartition(4)
    folder = f"file://{tmp_path}/warc"
    got = warc.read_archives(warc.write_archives(df, folder), folder).collect()
    assert len(got) == len(rows)
    assert sum(r.record_type == "response" for r in got) == 201
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {7}
    texts = extraction.extract_text(df).collect()
    assert len(texts) == len(rows) and sum(r.text == passage(40) for r in texts) == 300


TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]")


def discovered_brute(texts, rounds=3, support=3, least=0.5):
    """Candidate values that context makes instances, counted text by text."""
    from collections import Counter, defaultdict

    def contexts(before, after):
        t = TOKEN.findall(before.lower())[-3:]
        out = [("l", tuple(t[-i:])) for i in (1, 2, 3) if len(t) >= i]
        return out + [("r", (x[0],)) for x in [TOKEN.findall(after.lower())] if x]

    corpus, edges = Counter(), Counter()
    for text in texts:
        t = TOKEN.findall(text.lower())
        for i in range(len(t)):
            corpus.update([("r", (t[i],))] + [("l", tuple(t[i - k + 1:i + 1]))
                                              for k in (1, 2, 3) if i - k + 1 >= 0])
        spans = []
        for base, patterns in ((True, pii.BASE), (False, pii.CANDIDATE)):
            for kind, p in patterns.items():
                ms = list(regex.finditer(p, text))
                for n, m in enumerate(ms):
                    v, digits = m[0], regex.sub("[^0-9]", "", m[0])
                    if base and kind == "ip" and max(map(int, v.split("."))) > 255:
                        continue
                    if base and kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                        continue
                    if base and kind == "phone" and not 8 <= len(digits) <= 15:
                        continue
                    before = text[ms[n - 1].end() if n else 0:m.start()]
                    after = text[m.end():ms[n + 1].start() if n + 1 < len(ms) else len(text)]
                    spans.append((base, kind, m.start(), m.end(), v, contexts(before, after)))
        for base, kind, a, z, v, cs in spans:
            if base or not any(b and a < z2 and a2 < z for b, _, a2, z2, _, _ in spans):
                edges.update((c, kind, v, base) for c in cs)
    values = defaultdict(set)
    for c, kind, v, base in edges:
        values[c, kind].add((v, base))
    wanted = {c for (c, kind), vs in values.items()
              if len(vs) >= support and any(not b for _, b in vs)}
    seeds = {(kind, v): 1.0 for _, kind, v, base in edges if base}
    likely = dict(seeds)
    for _ in range(rounds):
        raw, held = defaultdict(float), defaultdict(set)
        for (c, kind, v, _), n in edges.items():
            if c in wanted and (kind, v) in likely:
                raw[c, kind] += n * likely[kind, v]
                held[c, kind].add(v)
        trusted = {p: min(1.0, x / corpus[p[0]]) for p, x in raw.items()
                   if len(held[p]) >= support and min(1.0, x / corpus[p[0]]) >= least}
        best = defaultdict(lambda: {"l": 0.0, "r": 0.0})
        for (c, kind, v, base) in edges:
            if not base and (c, kind) in trusted:
                best[kind, v][c[0]] = max(best[kind, v][c[0]], trusted[c, kind])
        likely = dict(seeds)
        for p, b in best.items():
            score = 1 - (1 - b["l"]) * (1 - b["r"])
            if score >= least:
                likely[p] = max(likely.get(p, 0), score)
    return {p for p in likely if p not in seeds}


def luhn(d):
    twice = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
    return sum(twice) % 10 == 0


def test_context_finds_what_the_patterns_leave(spark):
    label = "x" * 70
    texts = [f"Now my phone number is +1 415 555 {2000 + i}, thanks" for i in range(30)]
    texts += [f"Tel:+49 30 555 {1000 + i}." for i in range(12)]
    texts += [f"please dial: +44 20 7946 {1100 + i} today" for i in range(9)]
    texts += [f"{label} +1 212 555 {3000 + i}" for i in range(10)]
    texts += [f"write to a{i}@b{i}.org or call" for i in range(6)]
    texts += ["the phone number is 415 555 2671", "Tel:415 555 2672", "dial: 415 555 2673",
              f"{label} 415 555 2674", "a score is 415 555 9999 points", "at 222 333 4444",
              "write to jo (at) x (dot) com or call", None, "", "is it at the place"] + [
        f"this is {w} and that is {w}" for w in "abcdefgh" * 5]
    df = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(3)
    got = {(e.kind, e.value) for r in pii.find_personal_data(df).collect() for e in r.entities
           if not e.base}
    assert {("phone", f"415 555 267{i}") for i in (1, 2, 3, 4)} <= got
    assert ("email", "jo (at) x (dot) com") in got
    assert ("phone", "415 555 9999") not in got and ("phone", "222 333 4444") not in got
    assert got == discovered_brute([t or "" for t in texts])


def test_added_spans_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(e.kind, e.value) for r in pii.find_personal_data(df).collect() for e in r.entities}
    texts = [r.text or "" for r in df.collect()]
    added = {(e.kind, e.value) for r in pii.find_personal_data(df).collect()
             for e in r.entities if not e.base}
    assert added == discovered_brute(texts) and added <= got
