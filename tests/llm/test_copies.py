"""N-gram Jaccard join, substring removal, decontamination."""

import random
from itertools import combinations

import pytest

from plotline.llm import ngram_join, queries
from plotline.llm.decontaminate import contained_items, exact_shingles, without_items
from plotline.llm.ngram_join import MAX_BLOCKS, similar_groups
from plotline.llm.substring_dedup import drop_repeats
from tests.llm.conftest import prose


def shingles(text):
    return exact_shingles((text or "").encode().lower().split())


def components(texts):
    """Brute force over all pairs: smallest id reachable."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i)) for i in texts}


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(1 << 30)}"
    return words


def planted_texts(seed):
    """Groups of copies at various distances around the threshold, some of them chains."""
    r, texts = random.Random(seed), {}
    for size in (1, 2, 4, 5, 6, 7, 9, 12, 20, 40, 80, 150, 400):
        words = prose((seed, size).__hash__(), size).split()
        for edits in (0, 0, 1, 1, 2, 3, size // 60, size // 45, size // 30):
            texts[len(texts)] = " ".join(edited(words, min(edits, size), r))
            texts[len(texts)] = " ".join(words[: max(1, size - edits)])
        for _ in range(6):  # a chain: each a step further
            words = edited(words, max(1, size // 90), r)
            texts[len(texts)] = " ".join(words)
    return texts


@pytest.mark.parametrize(("seed", "most"), [(1, MAX_BLOCKS), (2, MAX_BLOCKS), (1, None)])
def test_groups_equal_brute_force(spark, seed, most):
    """The largest sets have whole sketches of more than a hundred blocks."""
    texts = planted_texts(seed)
    found = similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text", most).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(texts)


def test_group_beyond_one_tile_keeps_every_link(spark):
    """Near copies of one text that all share blocks, so that groups are large and leave them."""
    words, r = prose(77, 120).split(), random.Random(3)
    texts = {i: " ".join(edited(words, 1 + i % 4, r)) for i in range(160)}
    found = similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(texts)


def clusters(seed):
    """Texts of which all have more blocks than a cut sketch, in clusters so large that most blocks are, and parts at the edge of a link."""
    r, texts = random.Random(seed), {}
    for size in (300, 894):
        words = prose((seed, size, 1).__hash__(), size).split()
        copies = [[*words[:-1], f"last{i}"] for i in range(24)]  # all blocks but one agree
        copies += [words[: (size - 4) * 4 // 5 + 4], words[(size - 4) // 5 :], words[: (size - 4) * 4 // 5 + 3]]  # at the threshold, and under it
        share = prose((seed, size, 2).__hash__(), size // 2).split()
        for i in range(14):  # half of each is a passage that all share, and each has a partner
            own = [f"w{i}x{j}" for j in range(size - size // 2)]
            copies += [share + own, share + edited(own, size // 60, r), share + edited(own, size // 48, r)]
        for c in copies:
            texts[len(texts)] = " ".join(c)
    return texts


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("large", [3, 16])
def test_no_link_is_lost_where_all_shared_blocks_are_in_large_groups(spark, seed, large):
    """With few blocks in a cut sketch, agreement in large groups alone is common."""
    texts = clusters(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = similar_groups(df, "doc_id", "text", max_blocks=16, large_group=large).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(texts)


def test_documents_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = queries.QUERIES["op1_ngram_join"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(texts)


def test_groups_of_odd_rows(odd, no_rows):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar_groups(odd, "doc_id", "text").collect()]
    assert len(rows) == odd.count() and similar_groups(no_rows, "doc_id", "text").count() == 0
    assert {c for d, _, c in rows if d in (1, 2)} == {1} and {c for d, _, c in rows if d in (7, 8)} == {7}
    assert all((n, c) == (0, d) for d, n, c in rows if d in (4, 5, 6)) and all(c is None for d, _, c in rows if d is None)


def test_repeated_passages_go_and_the_rest_stays(spark):
    passage = ". ".join(prose(s, 12) for s in range(50, 56)) + "."
    own = [". ".join(prose((i, s).__hash__(), 11) for s in range(4)) + "." for i in range(4)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]}\n{passage}\n{own[3]}"), (3, own[0]), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["removed"] == []
    (span,) = got[2]["removed"]
    assert rows[1][1][span["start"] : span["end"]].strip() == passage and passage not in got[2]["text"]
    assert got[2]["text"].split() == f"{own[2]} {own[3]}".split()
    assert got[3]["text"] == "" and got[4]["text"] is None and got[5]["text"] == ""


def test_repeats_within_a_document_and_odd_rows(spark, odd, no_rows):
    line = prose(5, 25)
    df = spark.createDataFrame([(1, f"{line}\n{prose(6, 30)}\n{line}")], "doc_id long, text string")
    (row,) = drop_repeats(df, "doc_id", "text").collect()
    assert row["text"] == f"{line}\n{prose(6, 30)}" and len(row["removed"]) == 1
    rows = drop_repeats(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count() and drop_repeats(no_rows, "doc_id", "text").count() == 0
    assert {(r["doc_id"], bool(r["removed"])) for r in rows if r["doc_id"] in (1, 2, 9)} == {(1, False), (2, True), (9, False)}


def test_passages_of_short_lines_and_inside_long_sentences_go(spark):
    own = [f"{prose(i + 700, 30)}." for i in range(6)]
    menu = "\n".join(prose(i + 800, 1 + i % 3) for i in range(40))
    inner = prose(888, 90)
    rows = [(1, f"{own[0]}\n{menu}\n{own[1]}"), (2, f"{own[2]}\n{menu}\n{own[3]}"), (3, f"{own[4][:-1]} {inner} {prose(1, 9)}."), (4, f"{prose(2, 7)} {inner} {own[5]}")]
    got = {r["doc_id"]: r for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1]["removed"] == got[3]["removed"] == [] and got[2]["text"].split() == f"{own[2]} {own[3]}".split()
    (span,) = got[4]["removed"]
    gone = rows[3][1][span["start"] : span["end"]]
    assert gone.strip() in inner and len(gone.split()) >= 50


def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark):
    a, b, c, d = (f"{prose(i + 600, 25)}." for i in range(4))
    rows = [(1, a), (None, f"{a}\n{b}"), (None, f"{c}\n{d}"), (2, d), (2, c), (3, b), (3, b), (5, f"{prose(70, 30)}\n{prose(71, 30)}"), (5, f"{prose(72, 30)}\n{prose(71, 30)}")]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    of = lambda i: sorted(r["text"] for r in got if r["doc_id"] == i)
    assert of(1) == [a] and of(2) == sorted([c, d]) and of(3) == ["", b] and of(None) == ["", ""]
    assert sorted(len(t.split()) for t in of(5)) == [30, 60]
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{d}"), (1, a)]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted([b, rows[1][1]])


def test_spans_give_back_the_rest_on_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_substring_dedup"](spark, sf_dir).collect():
        text, spans = texts[r["doc_id"]], [tuple(map(int, s.split(":"))) for s in r["removed_spans"].split(",") if s]
        kept = text
        for a, b in reversed(spans):
            kept = kept[:a] + kept[b:]
        assert kept == r["text"]


def plain_removal(rows):
    """Brute force: every occurrence of every block of all rows in one list, the earliest stays."""
    from plotline.llm.substring_dedup import blocks_of, digest, repeated_spans, with_space, without_spans

    places = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    for k in order:
        _, words, blocks, _ = blocks_of(rows[k][1] or "")
        for b, (i, j) in enumerate(blocks):
            places.setdefault(digest([w for unit in words[i : j + 1] for w in unit]), []).append((k, b))
    repeats = {}
    for found in places.values():
        for k, b in found[1:]:
            repeats.setdefault(k, set()).add(b)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        spans = with_space(text, repeated_spans(text, repeats.get(k, set()))) if text else []
        out.append((doc_id, text and without_spans(text, spans), spans))
    return out


def test_removal_equals_brute_force(spark):
    """Few sentences dealt over many rows in many batches, ids repeated and missing."""
    r = random.Random(4)
    stock = [f"{prose(i + 400, r.choice((2, 3, 7, 12, 25)))}{r.choice(('.', '. ', chr(10), ' !  '))}" for i in range(60)]
    rows = [(r.choice((None, i, i, i // 3)), "  ".join(r.choice(stock) for _ in range(r.randrange(12))) + r.choice(("", " ", "\n"))) for i in range(150)] + [(3, None)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
            got = [(x["doc_id"], x["text"], [(s["start"], s["end"]) for s in x["removed"]]) for x in drop_repeats(df, "doc_id", "text").collect()]
            assert sorted(map(str, got)) == sorted(map(str, plain_removal(rows)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def leaks(docs, items, threshold=0.8, inside=1):
    found = set()
    for d, text in docs:
        words = (text or "").encode().lower().split()
        for i, item in items:
            s, width = shingles(item), len((item or "").split())
            own = exact_shingles(words, width if inside <= width < 5 else 5)
            if s and len(own & s) >= threshold * len(s) - 1e-9:
                found.add((d, i, len(s), len(own & s)))
    return found


def test_containment_equals_brute_force(spark):
    r = random.Random(8)
    items = [(i, prose(900 + i, n)) for i, n in enumerate((1, 3, 5, 6, 8, 15, 30, 60, 120))]
    items += [(98, None), (99, ""), (0, items[0][1]), (97, "what is two plus"), (96, "two Plus"), (95, "plus two")]
    docs = [(i, " ".join(edited(f"{prose(i, 200)} {items[i % 9][1].upper()} {prose(-i, 90)}".split(), i % 30, r))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, items[3][1]), (503, "So what is\nTWO plus two"), (504, "is two plus"), (505, "two plus"), (506, f"{prose(7, 30)} What is two plus")]
    made = [spark.createDataFrame(x, "doc_id long, text string") for x in (docs, items)]
    for max_hashes in (1 << 22, 10):
        found = contained_items(made[0], "doc_id", "text", made[1], "doc_id", "text", max_hashes=max_hashes).collect()
        assert {tuple(x) for x in found} == leaks(docs, items) and len(found) == len(leaks(docs, items))
        assert {(d, i) for d, i, _, _ in leaks(docs, items)} >= {(503, 97), (503, 96), (503, 95), (504, 96), (505, 96), (506, 97)}
        found = contained_items(made[0], "doc_id", "text", made[1], "doc_id", "text", max_hashes=max_hashes, inside=4).collect()
        assert {tuple(x) for x in found} == leaks(docs, items, inside=4)
    kept = without_items(made[0], "text", made[1], "doc_id", "text", max_hashes=10)
    assert {x["doc_id"] for x in kept.collect()} == {d for d, _ in docs} - {x[0] for x in leaks(docs, items, inside=5)}


def test_containment_of_odd_rows(odd, no_rows):
    hits = contained_items(odd, "doc_id", "text", odd, "doc_id", "text").collect()
    assert {(h["doc_id"], h["item_id"]) for h in hits} >= {(1, 2), (2, 1), (7, 8), (9, 9), (None, 1)}
    for docs, items in ((odd, no_rows), (no_rows, odd), (no_rows, no_rows)):
        assert contained_items(docs, "doc_id", "text", items, "doc_id", "text").count() == 0
    assert without_items(odd, "text", no_rows, "doc_id", "text").count() == odd.count()


def test_tables_of_keys_are_kept_in_few_files(spark, monkeypatch):
    parts, cut = [], ngram_join.checkpointed
    monkeypatch.setattr(ngram_join, "checkpointed", lambda df: parts.append((made := cut(df)).rdd.getNumPartitions()) or made)
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"{text} x{i % 3}") for i in range(12)], "doc_id long, text string")
    names = {"spark.sql.shuffle.partitions": "160", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        found = ngram_join.similar_groups(docs, "doc_id", "text").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 12 and {r["component_id"] for r in found} == {0}
    most = max(20, 4 * spark.sparkContext.defaultParallelism)
    assert len(parts) > 10 and sum(n > most for n in parts) <= 1
