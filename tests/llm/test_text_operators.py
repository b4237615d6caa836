"""Forms, copies, near-duplicates and leaks, against brute force and on odd tables."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from disputo.llm import copies, forms, leakage, neardup


def test_form_examples():
    same = [("ｆｕｌｌ　１２", "full 12"), ("café", "café"), ("ze​ro﻿", "zero"), ("a b c", "a b c"), ("sсаn", "scan"), ("Νοt", "Not"), ("ﬁne", "fine"), ("x­y", "xy"), ("a\r\nb", "a\nb"), ("сафé", "сафé")]
    for a, b in same:
        assert forms.form(a) == forms.form(b), (a, b)
    assert forms.form("привет мир") == "привет мир" and forms.form("ё́л") == forms.form("ё́л")
    assert forms.form("A b") != forms.form("a b") and forms.form("a  b") != forms.form("a b") and forms.form("a\nb") != forms.form("a b")
    assert forms.form("") == "" and len(forms.form("é x" * 100_000)) == 300_000


def test_form_is_stable():
    r = random.Random(3)
    alphabet = "aéеоА́​ ﬁ１ Ωο-\n" + "".join(map(chr, range(0x370, 0x500)))
    for _ in range(3000):
        once = forms.form("".join(r.choice(alphabet) for _ in range(r.randint(0, 12))))
        assert forms.form(once) == once


def test_same_form_pairs(spark):
    rows = [(1, "Scan​ it", "x"), (2, "Scan it", "y"), (3, "Scan it", None), (4, None, "z"), (5, "", "z"), (6, "​", "z"), (7, "", "z"), (None, "Scan it", "n"), (1, "Scan​ it", "x"), (8, "Sсan it", "w")]
    df = spark.createDataFrame(rows, "key long, text string, form string")
    got = {(r.key_a, r.key_b) for r in forms.same_form_pairs(df, "key", "text").collect()}
    assert got == {(1, 2), (1, 3), (1, 8), (2, 8), (3, 8)}
    groups = {r.key: (r.group_key, r.n_records) for r in forms.form_groups(df, "key", "text").collect()}
    assert groups == {k: (1, 4) for k in (1, 2, 3, 8)}
    assert forms.same_form_pairs(df.limit(0), "key", "text").count() == 0


LABELLED = "STRONGEST_PRO: One two.\nSTRONGEST_CON: Three!\nKEY_TENSION: Four\nMISSING_PERSPECTIVES: Five\nOVERALL_BALANCE: Six"


def test_copies(spark):
    moved = "\n".join(reversed(LABELLED.split("\n"))).lower().replace(" ", "  ")
    swapped = LABELLED.replace("One two.", "X").replace("Three!", "One two.").replace("X", "Three!")
    rows = [("a", "Hello, World"), ("b", "hello world!!"), ("c", "HELLOWORLD"), ("d", LABELLED), ("e", moved), ("f", swapped), ("g", "..."), ("h", "?"), ("i", None), ("j", ""), ("k", "world hello"), ("a", "Hello, World"), (None, "hello world"), ("l", "x" * 300_000), ("m", "X" * 300_000)]
    df = spark.createDataFrame(rows, "key string, text string").withColumns({"fields": F.lit(1), "fp_1": F.lit("clash"), "group_key": F.lit(2)})
    got = {r.key: (r.group_key, r.n_copies) for r in copies.copy_groups(df, "key", "text").collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 2), "e": ("d", 2), "f": ("f", 1), "k": ("k", 1), "l": ("l", 2), "m": ("l", 2)}
    assert {r.group_key: r.n_copies for r in copies.collapse(df, "key", "text").collect()} == {"a": 3, "d": 2, "f": 1, "k": 1, "l": 2}
    assert copies.copy_groups(df.limit(0), "key", "text").count() == 0


def test_collisions_are_found(spark, monkeypatch):
    monkeypatch.setattr(copies, "fingerprint", lambda fields, seed: F.lit(1).cast("long"))
    df = spark.createDataFrame([("a", "one"), ("b", "one."), ("c", "two")], "key string, text string")
    got = {r.key: (r.group_key, r.n_copies) for r in copies.copy_groups(df, "key", "text").collect()}
    assert got["b"][0] == "a" and got["c"] == ("c", 1)


def near_table():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    texts = [[r.choice(vocabulary) for _ in range(r.choice((1, 2, 3, 8, 20, 60, 150)))] for _ in range(120)]
    for base in list(texts):
        for _ in range(2):
            other = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 6))):
                other[r.randrange(len(other))] = r.choice(vocabulary)
            if r.random() < 0.3:
                r.shuffle(other)
            texts.append(other)
    return [("s" if i % 2 else "t", f"k{i:03}", " ".join(t)) for i, t in enumerate(texts)]


def brute(rows, threshold):
    words = {(s, k): set(re.findall(r"\w+", t)) for s, k, t in rows}
    content = {(s, k): t.replace(" ", "") for s, k, t in rows}
    keys = sorted(words)
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and content[a] != content[b] and len(words[a] & words[b]) >= threshold * len(words[a] | words[b])}


@pytest.mark.parametrize(("light", "chunk"), [(0, 1 << 15), (25, 1 << 15), (10_000, 1 << 15), (0, 3), (25, 3)])
def test_near_duplicates_lose_nothing(spark, monkeypatch, light, chunk):
    monkeypatch.setattr(neardup, "boundary", lambda costs: light)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "STEP", 50)
    rows = near_table()
    df = spark.createDataFrame([*rows, ("s", "null", None), ("s", None, "w1"), ("s", "empty", ""), ("s", "dots", "..."), rows[0]], "src string, key string, text string").withColumns({"tokens": F.lit(1), "n": F.lit(1), "set_id": F.lit("x")})
    links, members = neardup.near_duplicates(df, "src", "key", "text", 0.75, 1)
    got = {(r.src, r.key_a, r.key_b) for r in neardup.expanded_pairs(links, members).collect()}
    assert got == brute(rows, 0.75)
    assert members.count() == len(rows)


def test_near_duplicates_odd_tables(spark):
    schema = "src string, key string, text string"
    links, members = neardup.near_duplicates(spark.createDataFrame([], schema), "src", "key", "text")
    assert links.count() == 0 and members.count() == 0
    base = " ".join(f"w{i}" for i in range(200))
    rows = [("s", "a", base), ("s", "b", base + " more"), ("s", "c", base.upper()), ("s", "d", "short text")]
    links, members = neardup.near_duplicates(spark.createDataFrame(rows, schema), "src", "key", "text")
    got = {r.key: r.n_links for r in neardup.link_counts(links, members).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 0}


def test_words_have_one_order_in_all_sets():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    frequency = np.minimum(r.integers(0, 3, neardup.FREQUENCY_BUCKETS), 1)  # many ties
    words = [r.integers(-(2**63), 2**63 - 1, size=k) for k in (1, 5, 40, 700)]
    words.append(words[3][::2].copy())
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64()))], ["tokens"])
    tokens, row, position, _ = neardup._ranked(batch, frequency)
    ranked = [list(tokens[row == k]) for k in range(5)]
    assert [set(x) for x in ranked] == [set(x) for x in words] and list(position[row == 3]) == list(range(700))
    assert [x for x in ranked[3] if x in set(ranked[4])] == ranked[4]


def test_boundary_takes_the_cheaper_way():
    assert neardup.boundary([(5, 1.0, 10.0), (9, 2.0, 10.0), (30, 500.0, 10.0)]) == 9
    assert neardup.boundary([(5, 10.0, 1.0)]) == 0 and neardup.boundary([]) == 0


def test_tiling():
    assert leakage.tile([(0, 10, 20), (5, 0, 14)], 5) == [(0, 10, 20)]
    assert sorted(leakage.tile([(0, 10, 20), (15, 0, 14)], 5)) == [(0, 10, 20), (20, 5, 5)]


def test_leaks_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    items = [(i, [word() for _ in range(r.randint(5, 60))]) for i in range(12)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            _, it = r.choice(items)
            a = r.randrange(len(it))
            at = r.randint(0, len(text))
            text[at:at] = it[a : a + r.randint(3, 40)]
        docs.append((d, text))
    want = set()
    grams = defaultdict(set)
    for i, t in items:
        for k in range(len(t) - 12):
            grams[tuple(t[k : k + 13])].add(i)
    for d, t in docs:
        for k in range(len(t) - 12):
            want |= {(d, i) for i in grams.get(tuple(t[k : k + 13]), ())}
    documents = spark.createDataFrame([*[(d, ", ".join(t).upper(), 1) for d, t in docs], (900, None, 1), (901, "", 1), (None, "x", 1), (0, ", ".join(docs[0][1]).upper(), 1)], "doc_id long, text string, key int")
    table = spark.createDataFrame([*[(i, " ".join(t), 1) for i, t in items], (50, None, 1), (51, "", 1)], "item_id long, text string, seed int")
    rows = leakage.leaks(documents, table).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want and len(rows) == len(want)
    assert all(13 <= x.longest <= x.covered and 0 < x.coverage <= 1 for x in rows)
    assert leakage.leaks(documents, table.limit(0)).count() == 0 and leakage.leaks(documents.limit(0), table).count() == 0


def test_leaks_without_the_seed_filter(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(20))
    documents = spark.createDataFrame([(1, "so " + passage), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    monkeypatch.setattr(leakage, "SEED_FILTER", 0)
    r = leakage.leaks(documents, items).collect()
    assert [(x.doc_id, x.item_id, x.longest, x.coverage) for x in r] == [(1, 7, 20, 1.0)]


def test_colliding_contents_regroup(spark, monkeypatch):
    from disputo.llm import copies

    real = copies.fingerprint
    monkeypatch.setattr(copies, "fingerprint", lambda fields, seed: real(fields, seed) if seed == 37 else F.lit(1).cast("long"))
    df = spark.createDataFrame([("a", "one"), ("b", "One!"), ("c", "two"), ("d", "TWO"), ("e", "three")], "k string, t string")
    got = {r.key: (r.group_key, r.n_copies) for r in copies.copy_groups(df, "k", "t").collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 2), "d": ("c", 2), "e": ("e", 1)}


def test_groups_and_counts_of_versions(spark):
    from disputo.llm import neardup

    base = " ".join(f"w{i}" for i in range(20))
    rows = [("s", "a", base), ("s", "b", base + " extra"), ("s", "c", base.upper() + "!"), ("s", "d", "quite other words"), ("s", "e", " ".join(reversed(base.split()))), ("t", "f", base), ("s", "g", None)]
    df = spark.createDataFrame(rows, "src string, key string, text string").withColumn("set_id", F.lit(1))
    pairs, classes, members = neardup.similar_contents(df, "src", "key", "text", 0.75, 1)
    groups = {(r.src, r.key): (r.group_key, r.n_records) for r in neardup.near_groups(pairs, members).collect()}
    assert groups == {("s", k): ("a", 4) for k in "abce"}
    links, members2 = neardup.near_duplicates(df, "src", "key", "text", 0.75, 1)
    want = {(r.src, r.key): r.n_links for r in neardup.link_counts(links, members2).collect()}
    assert {(r.src, r.key): r.n_links for r in neardup.class_link_counts(pairs, classes, members).collect()} == want
    assert want[("s", "a")] == 2 and want[("s", "d")] == 0


def test_form_is_a_longest_match(spark):
    from disputo.llm import forms

    assert forms.form("é e‍́ е́clair") == "é é éclair"  # marks join what stands before them, also across hidden characters
    assert forms.form("ｶﾞ 한") == "ガ 한"
    assert forms.form("привет рay") == "привет pay"  # only words that show a Latin letter change
    for text in ("ﬁne Ｆull wid​th", "Ä̧́ ́", "½ №", "Ꮯat σne"):
        assert forms.form(forms.form(text)) == forms.form(text)


def test_look_alikes_that_conflict_are_refused(monkeypatch):
    import pytest

    from disputo.llm import forms

    monkeypatch.setitem(forms._LETTERS, 0xFF21, "A")  # full-width A has a rule already
    with pytest.raises(ValueError, match="conflicts"):
        forms.compile_table()
