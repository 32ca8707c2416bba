"""Secret scans, chat formatting, quality classifier, HTML extraction, SentencePiece."""

import hashlib
import json
import re
from itertools import product

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plotline.llm import chat_format as chat
from plotline.llm import piece_sampling, queries
from plotline.llm.html_extract import best_container, extract, host_of, main_text, parse
from plotline.llm.quality_classifier import LABELLERS, classify, fit_labels, kept_documents, votes_of
from plotline.llm.secret_scan import find_secrets, redact
from tests.llm.conftest import prose
from tests.oracle import rows_of, rows_of_sql

PATTERNS = {  # the contract's, with its limits applied afterwards
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24),
}


def base_of(text):
    found = [(m.start(), k, m.end()) for k, (p, g, n) in PATTERNS.items() for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], list(PATTERNS).index(x[1]))))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(queries.ORACLE_SQL[name], sf_dir)


def test_base_spans_of_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.QUERIES["op2_secret_scan"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        base = base_of(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(re.findall(k, base)) for k in PATTERNS]
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("random")) == base


def test_random_strings_found_and_known_ones_left(spark, odd, no_rows):
    secret = "q7Zt9xK2vB4mW8pL1sD6fH3j"
    rows = [
        (1, f"Zoë 😀 {secret} end"), (2, hashlib.sha256(b"a").hexdigest()), (3, "3f2504e0-4f89-11d3-9a0c-0305e82c3301"),
        (4, "internationalisation_of_documentation2"), (5, f"password = {secret}"), (6, "2024-01-01T00:00:00.000000Z"), (7, "paſsword=abcdefgh to\u212aen:abcdef"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], dict(rows)[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in find_secrets(df, "doc_id", "text").collect()}
    assert got[1] == [("random", secret)] and got[3] == got[4] == got[6] == [] and got[5] == [("assign", f"password = {secret}")]
    assert [k for k, _ in got[2]] == ["hex"] and got[7] == []  # the Kelvin sign and the long s are no ASCII letters
    clean = {r["doc_id"]: r["text"] for r in redact(df, "text").collect()}
    assert clean[1] == "Zoë 😀 [random] end" and clean[5] == "[assign]" and clean[4] == rows[3][1]
    found = find_secrets(odd, "doc_id", "text").collect()
    assert len(found) == odd.count() and all(r["spans"] == [] for r in found) and find_secrets(no_rows, "doc_id", "text").count() == 0
    assert redact(odd, "text").exceptAll(odd).count() == 0


def test_random_letters_and_the_rest_after_a_base_span_are_found(spark):
    letters, key, rest = "qVxZtKwBmRpLsDfHjGcNyXuT", "AKIA" + "Q7ZT9XK2VB4MW8PL", "qvxztkwbmrplsdfh"
    rows = [(1, f"see {letters} end"), (2, f"see {key}{rest} end"), (3, f"{letters}{key}"), (4, "internationalisation_of_documentation"), (5, "-" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], dict(rows)[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in find_secrets(df, "doc_id", "text").collect()}
    assert got == {1: [("random", letters)], 2: [("access", key), ("random", rest)], 3: [("random", letters), ("access", key)], 4: [], 5: []}
    clean = {r["doc_id"]: r["text"] for r in redact(df, "text").collect()}
    assert clean[1] == "see [random] end" and clean[2] == "see [access][random] end"


def test_turns_return_from_hostile_texts():
    pieces = ["<|im_start|>", "<|im_", "end|>", "\\", "<s>", "[INST]", "\n", "<|im_sep|>", "a"]
    for text in map("".join, product(pieces, repeat=3)):
        whole = chat.render("us<s>er", text) + chat.render("assistant", text[::-1])
        assert chat.read_back(whole) == [("us<s>er", text), ("assistant", text[::-1])]
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    with pytest.raises(ValueError):
        chat.read_back(chat.render("user", "x") + "rest")


def test_layouts_become_the_same_turns():
    want = [("user", "ask"), ("assistant", "say")]
    for record in (
        {"prompt": "ask", "completion": "say"}, {"instruction": "ask", "output": "say"}, {"question": "ask", "answer": "say"},
        {"messages": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": "say"}]},
        {"conversations": [{"from": "human", "value": "ask"}, {"from": "gpt", "value": "say"}]},
    ):
        assert chat.canonical_turns(record)[1] == want
    assert chat.canonical_turns({"instruction": "a", "input": "b", "output": "c"})[1] == [("user", "a\n\nb"), ("assistant", "c")]
    assert chat.canonical_turns({"other": 1})[1] is None
    system = [("system", "be brief"), *want]
    assert chat.canonical_turns({"system": "be brief", "prompt": "ask", "completion": "say", "id": 7, "meta": {"tags": ["a"]}})[1] == system
    assert chat.canonical_turns({"messages": []})[1] == [] and chat.canonical_turns({"messages": [{"role": "user", "content": None, "name": "x"}]})[1] == [("user", "")]
    assert chat.canonical_turns({"prompt": "a", "completion": "b", "response": "c"})[1] is None  # two layouts at once


def test_a_table_of_mixed_layouts(spark):
    """Records of every layout in one table, some with other fields; unknown ones are counted."""
    ask, say = "a </s> \\ [INST]", "s<|im_end|>\n"
    records = [
        {"prompt": ask, "completion": say, "source": "x"}, {"question": ask, "answer": say}, {"instruction": ask, "input": "", "output": say},
        {"messages": [{"role": "user", "content": ask, "weight": 1}, {"role": "assistant", "content": say}]}, {"conversations": [{"from": "human", "value": ask}, {"from": "gpt", "value": say}]},
        {"messages": []}, {"unheard": ask}, {"messages": [{"role": "user"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_records(df, "conv_id", None, "record")).collect()}
    whole = hashlib.sha256(f"user\n{ask}\nassistant\n{say}\n".encode()).hexdigest()
    assert all((got[i]["n_turns"], got[i]["turns_sha256"], got[i]["loss_chars"], got[i]["n_unknown"]) == (2, whole, len(say), 0) for i in range(5))
    assert [(got[i]["n_turns"], got[i]["n_unknown"]) for i in (5, 6, 7)] == [(0, 0), (0, 1), (0, 1)]


def test_odd_records(spark):
    rows = [(1, 0, "[1]"), (1, 1, None), (1, 2, "{"), (1, 3, json.dumps({"role": "assistant", "text": None})), (None, None, json.dumps({"role": None, "text": "x"}))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, record string, part string")
    done = chat.format_records(df, "conv_id", "turn", "record")
    assert done.count() == 5 and done.where("formatted is null").count() == 3
    got = {r["conv_id"]: r for r in chat.digests(done).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (1, 0) and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_records(df.where("false"), "conv_id", "turn", "record")).count() == 0


def test_labels_are_learned_without_labels():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, len(LABELLERS))) < 0.5, 0, np.where(rng.random((4000, len(LABELLERS))) < 0.85, 1 + good[:, None], 2 - good[:, None]))
    patterns = [("".join(map(str, v)), 1) for v in votes]
    model = fit_labels(patterns)
    guessed = np.array([model.posterior(v) > 0.5 for v, _ in patterns])
    assert (guessed == good).mean() > 0.9 and abs(model.good - 0.7) < 0.08


def test_held_out_accuracy(spark):
    """The labels of the table are never used in fitting."""
    d = "/root/testdata/sf0.1"
    found = queries.QUERIES["op4_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("quality is not null")
    assert found.where(F.col("keep").cast("int") == F.col("quality")).count() / found.count() > 0.95


def test_classifier_on_odd_rows(odd, no_rows):
    found = classify(odd, "doc_id", "text").collect()
    assert len(found) == odd.count() and all((r["score"], r["keep"]) == (0.0, False) for r in found if r["doc_id"] in (4, 5, 6))
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    assert classify(no_rows, "doc_id", "text").count() == kept_documents(no_rows, "doc_id", "text").count() == 0
    assert kept_documents(odd, "doc_id", "text").columns == odd.columns and votes_of(None) == votes_of(" ") == "0" * len(LABELLERS)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article class="post post-%d"><h1>Title&nbsp;&amp; more</h1><p>First   <b>bold</b>
paragraph %s</p><p>Second &lt;tag&gt; one %s<p>Third</p><form><p>Search</p></form><ul><li>Item one<li>Item two</ul></article>
<div class="comments"><p>%s</p></div><footer>Foot</footer><script>if (a < b) { "<p>no</p>" }</script></body></html>"""


def page(i):
    return PAGE % (i, prose(i, 30), prose(-i, 30), prose(i + 500, 300))


def test_article_without_surroundings():
    want = [f"First bold paragraph {prose(3, 30)}", f"Second <tag> one {prose(-3, 30)}", "Third", "Item one", "Item two"]
    assert extract(page(3), None) == "\n\n".join(["Title & more", *want])


def test_hosts(spark):
    df = spark.createDataFrame([("HTTPS://user@Example.org:80/a?b",), (None,), ("x",)], "url string")
    assert [r[0] for r in df.select(host_of(F.col("url"))).collect()] == ["example.org", "", ""]


@pytest.mark.parametrize("around", [
    '<div class="layout with-sidebar"><article>{}</article><div class="sidebar"><p>Side</p></div></div>', '<article class="post comments-open">{}</article>',
    '<article class="post category-alert">{}</article>', '<svg><path d=""><article>{}</article>', '<div class="widget">{}</div><p>Short</p>',
    '<div class="page-wrap sidebar"><main>{}</main></div>', '<script>var a = 1;<div>{}</div>', '<div class="notice" id="post"><div>{}</div></div>',
    '<div class="post">{}</div><div class="comment-list"><article class="comment-body"><p>Reply</p></article></div>',
    '<div id="comments"><p>First! %s</p></div><div class="story">{}</div>' % prose(5, 400), '<div class="has-no-ads"><section>{}</section></div>',
])
def test_an_article_stays_whatever_its_names(around):
    paragraphs = [prose(i + 40, 40) for i in range(3)]
    source = "<html><body><nav>Menu</nav>" + around.replace("{}", "".join(f"<p>{x}</p>" for x in paragraphs)) + "<footer>Foot</footer></body></html>"
    assert extract(source, None) == "\n\n".join(paragraphs)


def test_an_article_in_sibling_containers_is_whole():
    lead, more, rest = (prose(i + 60, 40) for i in range(3))
    inner = f'<div class="lead"><p>{lead}</p><p>{more}</p></div><div class="rest"><p>{rest}</p></div>'
    for source in (f'<body><div class="story">{inner}</div><div class="links"><a href="/">{prose(3, 50)}</a></div></body>', f"<body>{inner}</body>"):
        assert extract(source, None) == "\n\n".join((lead, more, rest))


def test_host_path_and_odd_pages(spark):
    rows = [(i, f"http://h/{i}", page(i)) for i in range(8)] + [(90, "http://h/x", None), (91, None, ""), (92, "http://h/y", "plain <b>text"), (None, None, page(1)), (None, None, page(1))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in main_text(df, "page_id", "url", "html").collect()}
    assert main_text(df, "page_id", "url", "html").count() == len(rows) and main_text(df.where("false"), "page_id", "url", "html").count() == 0
    assert got[90] == got[91] == "" and got[92] == "plain text" and all(got[i] == extract(page(i), None) for i in range(8)) and got[None] == got[1]
    dealt = main_text(df, "page_id", "url", "html", max_hosts=1, host_pages=3).collect()
    assert sorted(map(str, dealt)) == sorted(map(str, main_text(df, "page_id", "url", "html").collect()))


def test_pages_equal_brute_force(spark, sf_dir):
    """Votes counted in one dictionary, and each page extracted by its host's path, give the query's texts."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html", host_of(F.col("url")).alias("host")).collect()
    votes = {}
    for r in rows:
        if r["html"] and (best := best_container(parse(r["html"]))):
            n, weight = votes.setdefault(r["host"], {}).get(best[1], (0, 0))
            votes[r["host"]][best[1]] = (n + 1, weight + round(best[2]))
    paths = {h: min(v, key=lambda p: (-v[p][0], -v[p][1], p)) for h, v in votes.items()}
    found = {r["page_id"]: r["text"] for r in queries.QUERIES["op6_html_extract"](spark, sf_dir).collect()}
    assert found == {r["page_id"]: extract(r["html"], paths.get(r["host"])) for r in rows}


def test_pages_have_no_markup_left(spark, sf_dir):
    rows = queries.QUERIES["op6_html_extract"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and not re.search(r"</?(p|div|span)\b|[ \t]{2}|\n{3}|&amp;", r["text"]) for r in rows)
    assert sum(r["n_chars"] > 0 for r in rows) > 0.9 * len(rows)


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")


def test_encoding_equals_the_library_and_returns(spark, odd, no_rows, sf_dir, processor):
    for df in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        found = piece_sampling.encode(df, "doc_id", "text")
        rows = [r for r in found.collect() if r["doc_id"] not in (3, None)]
        for r in rows:
            assert r["ids"] == processor.encode(texts[r["doc_id"]] or "")
            assert r["round_trip"] == (processor.decode(r["ids"]) == (texts[r["doc_id"]] or ""))
        again = {r["doc_id"]: r["back"] for r in piece_sampling.decode(found, "ids", "back").collect()}
        assert all(again[r["doc_id"]] == texts[r["doc_id"]] for r in rows if r["round_trip"] and texts[r["doc_id"]])
    assert piece_sampling.encode(no_rows, "doc_id", "text").count() == 0


def test_round_trip_is_that_of_the_decoded_whole(spark, processor):
    texts = dict(enumerate(("foo▁bar", "▁", "a ▁b", "plain text", " two  spaces ", "▁▁x\ny")))
    rows = piece_sampling.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"]: r["round_trip"] for r in rows} == {i: processor.decode(processor.encode(t)) == t for i, t in texts.items()}
    assert not rows[0]["round_trip"] and {r["doc_id"]: r["round_trip"] for r in rows}[3]


def test_samples_are_distinct_segmentations(spark, odd, processor):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    rows = [r for r in piece_sampling.encode(odd, "doc_id", "text", samples=4).collect() if r["doc_id"] not in (3, None)]
    for r in rows:
        samples = r["samples"]
        assert len({tuple(s["ids"]) for s in samples}) == len(samples) == (0 if not texts[r["doc_id"]] else len(samples))
        assert all(processor.decode(s["ids"]) == texts[r["doc_id"]] for s in samples if r["round_trip"])
        assert [s["value"] for s in samples] == sorted((s["value"] for s in samples), reverse=True) and all(s["log_inclusion"] <= 0 for s in samples)
    same = [r["samples"] for r in rows if r["doc_id"] == 2]
    assert same[0] == same[1]


@pytest.fixture(scope="module")
def lattices():
    with open("/opt/tokenizers/piece_bpe_32k.model", "rb") as f:
        return piece_sampling.Lattices(f.read(), 1.0)


def test_sampling_follows_the_lattice(lattices):
    """Over many keys the first draw of a short word has the chances of its segmentations."""
    n, keys = 20_000, piece_sampling.mix64(np.arange(20_000, dtype=np.uint64))
    found = piece_sampling.sample_rows(lattices, lattices.units_of(["the"]) * n, keys, 2)
    counts, chances = {}, {}
    for first, *_ in found:
        counts[tuple(first[0])] = counts.get(tuple(first[0]), 0) + 1
        chances[tuple(first[0])] = np.exp(first[1])
    assert all(abs(counts[s] / n - p) < 0.02 for s, p in chances.items()) and sum(chances.values()) > 0.97
    assert all(len({tuple(s[0]) for s in row}) == len(row) for row in found)


def all_segmentations(lattices, text):
    """Brute force: pieces (or code points without one) of every segmentation of a text, with its chance."""
    processor, shown = lattices.processor, "▁" + text.replace(" ", "▁")
    n, plain = processor.vocab_size(), [i for i in range(processor.vocab_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
    weight = {processor.id_to_piece(i): (2.0 + min(-processor.get_score(i), float(n))) ** -1.0 for i in plain}
    found = {}

    def grow(at, parts, w):
        if at == len(shown):
            found[tuple(parts)] = w
        for end in range(at + 1, len(shown) + 1):
            piece = shown[at:end]
            if piece in weight:
                grow(end, [*parts, piece], w * weight[piece])
            elif end == at + 1:
                grow(end, [*parts, piece], w * np.exp(-30.0))

    grow(0, [], 1.0)
    ids = lambda p: [processor.piece_to_id(p)] if p in weight else [processor.piece_to_id(f"<0x{b:02X}>") for b in p.encode()]
    return {tuple(i for p in parts for i in ids(p)): w / sum(found.values()) for parts, w in found.items()}


@pytest.mark.parametrize("text", ["the", "a", "of it", "nö1", "x\n\u2603y"])
def test_all_segmentations_come_out_in_order(lattices, text):
    """With room for all of them, every segmentation is found once, with its chance, however small."""
    whole = all_segmentations(lattices, text)
    keys = piece_sampling.mix64(np.arange(50, dtype=np.uint64))
    for row in piece_sampling.sample_rows(lattices, lattices.units_of([text]) * 50, keys, len(whole) + 3):
        ids = [tuple(x.tolist()) for x in lattices.spelled([s[0] for s in row])]
        assert sorted(ids) == sorted(whole) and all(np.isclose(s[1], np.log(whole[i])) for s, i in zip(row, ids, strict=True))
        values = [s[2] for s in row]
        assert values == sorted(values, reverse=True) and all(s[3] == 0.0 for s in row)


def test_pairs_of_draws_and_inclusion_scores_follow_the_law(lattices):
    """Ordered pairs have the chance p * q / (1 - p) of drawing without replacement, and inclusion scores weigh samples without bias."""
    text, n = "of the", 40_000
    whole = all_segmentations(lattices, text)
    keys = piece_sampling.mix64(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40))
    rows = piece_sampling.sample_rows(lattices, lattices.units_of([text]) * n, keys, 2)
    flat = iter(lattices.spelled([s[0] for row in rows for s in row]))
    pairs, estimate = {}, 0.0
    for row in rows:
        a, b = (tuple(next(flat).tolist()) for _ in row)
        pairs[a, b] = pairs.get((a, b), 0) + 1
        estimate += sum(np.exp(s[1] - s[3]) for s in row) / n
    wrong = sum(abs(pairs.get((a, b), 0) / n - p * q / (1 - p)) for a, p in whole.items() for b, q in whole.items() if a != b)
    often = [(a, b) for a, p in whole.items() for b, q in whole.items() if a != b and p * q / (1 - p) > 0.005]
    assert all(abs(pairs.get((a, b), 0) / n - whole[a] * whole[b] / (1 - whole[a])) < 0.006 for a, b in often) and often
    assert wrong < 0.15 and abs(estimate - 1) < 0.02


def test_samples_depend_on_the_row_alone(lattices):
    texts = [prose(i, 5 + 40 * (i % 4)) + " \n ¼☃" for i in range(12)]
    keys = piece_sampling.mix64(np.arange(12, dtype=np.uint64))
    together = piece_sampling.sample_rows(lattices, lattices.units_of(texts), keys, 3)
    for t, key, row in zip(texts, keys, together, strict=True):
        lattices.clear()
        (alone,) = piece_sampling.sample_rows(lattices, lattices.units_of([t]), np.array([key]), 3)
        assert [s[1:] for s in alone] == [s[1:] for s in row]


def test_units_longer_than_a_slice(lattices, monkeypatch):
    monkeypatch.setattr(piece_sampling, "SLICE_CHARS", 7)
    texts = ["antidisestablishmentarianism of " * 5, "", "a b", "z" * 300]
    keys = np.arange(4, dtype=np.uint64)
    short = piece_sampling.sample_rows(lattices, lattices.units_of(texts), keys, 2)
    monkeypatch.undo()
    lattices.clear()
    assert [[s[1:] for s in r] for r in short] == [[s[1:] for s in r] for r in piece_sampling.sample_rows(lattices, lattices.units_of(texts), keys, 2)]
    assert all(lattices.processor.decode(lattices.spelled([r[0][0]])[0].tolist()) == t for t, r in zip(texts, piece_sampling.sample_rows(lattices, lattices.units_of(texts), keys, 2)) if t)


STORY = ("A first paragraph of the story that is long enough to be counted as prose by anyone.", "A second paragraph of the story, which also goes on for a good while before it ends.")
TOLD = "".join(f"<p>{p}</p>" for p in STORY)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(6)) + "</ul>"


@pytest.mark.parametrize("source", [
    f"<html><head><title>x</title><body><div class=story>{TOLD}</div></body></html>",
    f"<html><head><title>x</title><meta charset=utf-8><div class=story>{TOLD}</div>",
    f"<body><form id=whole><div class=menu>{MENU}</div><div class=story>{TOLD}</div><input name=q></form></body>",
    f"<body><nav>{MENU}<div class=story>{TOLD}</div></body>",
    f"<body><nav>{MENU}</nav><article><div class='post-reply'>{TOLD}</div></article></body>",
    f"<body><article>{TOLD}</article><div class=comments><article><p>{STORY[0] * 9}</p></article></div></body>",
    f"<body><div class=story>{TOLD}<p style='display: none'>{STORY[0]}</p><div style=\"color:red;visibility:hidden\">{STORY[1]}</div></div></body>",
    f"<body><article>{TOLD}</article><form><p>{STORY[0]}</p></form><nav><p>{STORY[1] * 9}</p></nav></body>",
])
def test_articles_that_odd_markup_hides(source):
    assert extract(source, None) == "\n\n".join(STORY)


def test_several_articles_of_a_page_are_kept():
    third = "A third paragraph stands in an article of its own, and it is prose of the same length."
    source = f"<body><main><article>{TOLD}</article><article><p>{third}</p></article><article><a href=/x>{third}</a></article></main><footer>{third}</footer></body>"
    assert extract(source, None).split("\n\n")[:3] == [*STORY, third]
    teasers = f"<body><article>{TOLD * 5}</article><div><article><p>{third}</p></article><article><p>{third}</p></article></div></body>"
    assert extract(teasers, None) == "\n\n".join(STORY * 5)
