"""Each operator against its plain version, over rows with nulls, repeats, ties, odd texts and clashing columns."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

from tests.llm import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bpe, chat_format, exact_dedup, jaccard_join, lang_id, line_dedup, lm_score, mixing, quality, sharding
from marlstone.llm.queries import ORACLES, QUERIES, TOKENIZERS

SF = "/root/testdata/sf0.001"
VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n long, run int, digest string, size int, key long, part int, kept boolean"


def prose(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def edge_rows():
    base = [(None, "no id here"), (1, None), (2, ""), (3, " \t\n "), (4, "A  b\tc"), (5, "A b c"), (6, "Äé 中文 🎉 ok"), (7, "x" * 5000), (8, prose(1, 400)), (9, prose(1, 400)), (9, prose(1, 400)), (10, "one"), (11, prose(2, 30)), (12, "1 2 3 !!")]
    return [(d, t, *([None, None] if i % 5 == 0 else ["en", f"s{i % 3}"]), 1, 2, "x", 3, 4, 5, True) for i, (d, t) in enumerate(base)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(repr, rows))


def test_exact_dedup(odd, empty, small):
    for df in (odd, small):
        got = exact_dedup.exact_dedup(df)
        assert ordered(tuple(r) for r in got.collect()) == ordered(brute.exact(pairs_of(df)))
    assert exact_dedup.exact_dedup(empty).count() == 0
    narrow = exact_dedup.exact_dedup(odd, round_bits=1, rounds=3)
    assert ordered(map(tuple, narrow.collect())) == ordered(brute.exact(pairs_of(odd)))


def test_shard_law(odd, empty, small):
    for df, n in ((odd, 16), (small, 16), (small, 3)):
        rows = sharding.shard(df, n).collect()
        total = df.count()
        counts = Counter(r["shard"] for r in rows)
        assert len(rows) == total and max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1
        for s in range(n):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
        texts = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs_of(df))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    again = sharding.shard(small.repartition(5)).select("doc_id", "shard", "slot").collect()
    assert sorted(again) == sorted(sharding.shard(small).select("doc_id", "shard", "slot").collect())
    assert sharding.shard(empty).count() == 0


def test_hypergeometric_is_exact_and_uniform():
    import numpy as np

    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 30, 100, 20) for _ in range(20000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert 0 <= sharding.hypergeometric(rng, 3 * 10**9, 5 * 10**10, 10**6) <= 10**6
    lines = sharding.communication_matrix([5, 0, 7, 9], [6, 5, 5, 5], 3)
    assert [sum(x) for x in lines] == [5, 0, 7, 9] and [sum(x) for x in zip(*lines, strict=True)] == [6, 5, 5, 5]


def test_mix(odd, empty, small):
    for df in (odd, small):
        rows = mixing.mix(df).collect()
        sizes = defaultdict(int)
        for r in df.select("source", "text").collect():
            sizes[r["source"]] += len(brute.words(r["text"]))
        want = brute.targets(dict(sizes))
        taken, longest = defaultdict(int), defaultdict(int)
        assert len(rows) == df.count()
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
            taken[r["source"]] += r["taken"]
            longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert sum(taken.values()) <= sum(sizes.values())
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 2 * max(longest.values())
    again = mixing.mix(small.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(again) == sorted(mixing.mix(small).select("doc_id", "taken").collect())
    assert mixing.mix(empty).count() == 0


def test_mix_serves_by_finish_time(small):
    """The cut is where a queue served one copy at a time would stop."""
    rows = mixing.mix(small)
    queue = rows.collect()
    # Rebuild the finish times from the materialised order: within a source, copies are all-or-nothing by time.
    by = defaultdict(list)
    for r in queue:
        by[r["source"]].append(r)
    for members in by.values():
        spread = {r["copies"] for r in members if r["size"]}
        assert max(spread) - min(spread) <= 1


def served(rows, weights_targets, most=3):
    """A plain queue: rows (key, source, size), in each source's order -> how often each is served within the total."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    queue, upto = [], defaultdict(int)
    for key, s, n in rows:
        upto[s] += n
        queue += [((k * sizes[s] + upto[s]) / weights_targets[s], rank[s], upto[s], n, key) for k in range(most) if n]
    left, times = sum(sizes.values()), Counter()
    for *_, n, key in sorted(queue, key=lambda x: x[:3]):
        if n > left:
            break
        left -= n
        times[key] += 1
    return times


@pytest.mark.parametrize("slice_rows", [7, 250_000])
def test_mix_takes_what_a_plain_queue_serves(spark, small, slice_rows):
    """Over the test table, and over many sources of equal size, whose copies all finish at the same times."""
    alike = spark.createDataFrame([(i, "five words in each one", f"s{i:03d}") for i in range(60)], "doc_id long, text string, source string")
    for df in (small, alike):
        got = mixing.mix(df, slice_rows=slice_rows)
        keyed = got.withColumn("key", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text_hash")).collect()
        order = sorted(keyed, key=lambda r: (r["key"] % (1 << 64), r["doc_id"]))
        want = served([(r["doc_id"], r["source"], r["size"]) for r in order], {r["source"]: r["target"] for r in order})
        assert {r["doc_id"]: r["copies"] for r in order if r["copies"]} == dict(want) and sum(r["taken"] for r in order) > 0


def test_mixed_rows_keeps_rows_that_differ_in_further_columns(spark):
    rows = [(1, "a b c", "s", x) for x in range(4)] + [(2, "d e f", None, None), (None, "g h", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `key` long")
    taken = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_rows(df).collect())
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["copies"]
    assert {k[0]: n for k, n in taken.items()} == {k: n for k, n in want.items() if n}
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and len({r["key"] for r in mixed.filter("doc_id = 1").collect()}) == min(4, want[1])


def test_mixed_rows(small, odd):
    out = mixing.mixed_rows(small)
    assert out.columns == small.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(small).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(want)
    assert mixing.mixed_rows(odd).count() == sum(r["copies"] for r in mixing.mix(odd).collect())


def test_lm_score(odd, empty, small):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    for df in (small, odd.filter("doc_id is null or doc_id <> 9").union(odd.filter("doc_id = 9").limit(1))):
        want = brute.bigram_scores(pairs_of(df), held, lm_score.discounts)
        for r in lm_score.score_held_out(df).collect():
            n, known, tokens, base, score = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), n, known, tokens)
            assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=1e-6)
    got = lm_score.score_held_out(small).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    assert lm_score.score_held_out(empty).count() == 0


def test_lang_id(odd, empty, small, spark):
    rows = QUERIES["op5_lang_id"](spark, SF).collect()
    true = {r["doc_id"]: r["lang"] for r in small.collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == small.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) / len(held) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    model = lang_id.train(small)
    got = {(r["doc_id"]): r["lang_pred"] for r in lang_id.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[12] == "und" and got[6] != "und"
    assert lang_id.identify_held_out(empty).count() == 0


def test_lang_id_has_a_label_for_every_language(spark):
    """70 languages of unlike words; the rarest ones are labels, too, and known again."""
    r = random.Random(8)
    rows = []
    for k in range(70):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(3)]
        rows += [(" ".join(r.choice(words) for _ in range(60)), f"l{k:02d}") for _ in range(12 if k < 64 else 8)]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    model = lang_id.train(df)
    assert model.labels == [f"l{k:02d}" for k in range(70)]
    got = lang_id.identify(df, model).join(df, "doc_id").filter("lang >= 'l64'").collect()
    assert len(got) == 48 and sum(x["lang_pred"] == x["lang"] for x in got) >= 40


def test_bpe_matches_the_library(small, odd, spark):
    library = Tokenizer.from_file(VOCABULARY)
    for df in (small, odd):
        got = sorted(map(tuple, bpe.code_digests(df, VOCABULARY).collect()), key=repr)
        want = []
        for d, t in pairs_of(df):
            ids = library.encode(t or "", add_special_tokens=False).ids
            said = library.decode(ids, skip_special_tokens=False)
            want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    few = small.limit(5)
    back = bpe.decode(bpe.encode(few, VOCABULARY), VOCABULARY).collect()
    for r in back:
        assert r["decoded"].split()[:1] and "".join(r["decoded"].split()) == "".join(r["text"].lower().split())


LIBRARY = Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("etaoinshrdlu'.!,0123 <|>#Σİé́\u0085\x1c "), st.characters(codec="utf-8", exclude_categories=("Cs", "Cn"))), max_size=80))
def test_bpe_on_any_text(text):
    coder = bpe.encoder(VOCABULARY)
    ids = coder.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    machine = bpe.Decoder(coder.v)
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("etaoinshrdlu'.!,0123 <|>#Σİé́\u0085\x1c\n\0 "), st.characters(codec="utf-8", exclude_categories=("Cs", "Cn"))), max_size=120), max_size=5))
def test_bpe_of_many_texts_at_once(texts):
    want = []
    for text in texts:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        said = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert bpe.code_texts(texts, VOCABULARY) == want


def test_bpe_forgets_pieces_without_losing_any(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    monkeypatch.setattr(bpe, "HELD_CHARS", 300)
    texts = [prose(k, 60, vocabulary=25) for k in range(12)]
    monkeypatch.setattr(bpe, "_coder", lambda path, coder=bpe.Coder(VOCABULARY): coder)
    for (n, digest, _), text in zip(bpe.code_texts(texts, VOCABULARY), texts, strict=True):
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert (n, digest) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())


@pytest.mark.parametrize("text", ["a" * 20000, "na" * 5000, "!" * 4000, "thethe" * 800, "x<|endoftext|>y<|startoftext|>", "é" * 3000])
def test_bpe_streams_long_words_in_bounded_memory(text):
    coder = bpe.encoder(VOCABULARY)
    assert coder.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    machine, most = bpe.Transducer(coder.v), 0
    signs = [coder.signs[b] for b in ("abc" * 5000).encode()]
    for i in range(0, len(signs), 64):
        machine.push(signs[i : i + 64])
        most = max(most, len(machine.signs))
    assert most <= 2 * (coder.v.lookahead + coder.v.longest) + 64


def test_line_dedup(small, odd, empty, spark):
    for df in (small, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = line_dedup.dedup_lines(df).collect()
        assert {r["doc_id"]: r["text"] for r in rows} == brute.lines_left(pairs_of(df))
        assert set(rows[0].asDict()) == {*df.columns, "n_lines", "n_dropped"}
    notice = "This page was last edited on {} by nobody in the whole wide world of letters"
    texts = [(i, f"{prose(i, 30)}\n{notice.format(i * 31)}") for i in range(6)]
    varied = " ".join(f"v{chr(97 + k)}" for k in range(18))
    texts += [(10, varied), (11, varied.replace("vh", "other")), (12, varied.replace("vb", "start"))]
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all("last edited" not in left[i] for i in range(1, 6)) and "last edited" in left[0]
    assert left[10] == varied and left[11] == "" and left[12] != ""
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_with_other_ids_and_clashing_names(spark):
    notice = "all of the rights to this page are reserved by its owners"
    rows = [(k, f"{prose(i, 12)}\n{notice}", i) for i, k in enumerate(["b", "a", None, None, "c"])]
    df = spark.createDataFrame(rows, "doc_id string, text string, own_hash long").withColumns({"ident": F.lit(1), "dropped": F.lit("x")})
    left = line_dedup.dedup_lines(df.repartition(3))
    assert left.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"] or "", r["n_dropped"]) for r in left.collect()) == [("", 1), ("", 1), ("a", 0), ("b", 1), ("c", 1)]
    top = spark.createDataFrame([((1 << 63) - 1, notice), (None, notice)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(top).collect()} == {(1 << 63) - 1: 0, None: 1}
    alone = spark.createDataFrame([(None, notice), (None, notice)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(alone).collect()} == {0}


def test_chat_format_round_trip(spark):
    r = random.Random(5)
    bits = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "<\\|", "[\\INST]", "\n", "a", "é", chat_format.END, chat_format.TURN, chat_format.BODY]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "<|x|>"]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randrange(12)))) for c in range(40) for t in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(chat_format.as_events(df))).collect()
    for x in back:
        mine = sorted((y for y in rows if y[0] == x["conv_id"]), key=lambda y: y[1])
        assert [(t["role"], t["text"]) for t in x["turns"]] == [(y[2] or "", y[3] or "") for y in mine]
        assert x["loss"] == [y[3] or "" for y in mine if y[2] == "assistant"]
        for mark in ("</s>", "[INST]", "<<SYS>>"):
            assert mark not in x["formatted"]
    spans = chat_format.format_chats(chat_format.as_events(df)).collect()
    for x in spans:
        texts = [y[3] or "" for y in sorted(rows, key=lambda y: y[1]) if y[0] == x["conv_id"] and y[2] == "assistant"]
        assert len(x["loss_spans"]) == len(texts)
        for s, t in zip(x["loss_spans"], texts, strict=True):
            cut = x["formatted"][s["start"] : s["start"] + s["length"]]
            assert spark.createDataFrame([(cut,)], "x string").select(chat_format.unescape(F.col("x"))).first()[0] == t if "\\" in cut else cut == t


def test_chat_format_folds_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, "delta", None, "llo"), (1, 3, 1, "regenerate", None, "x"), (1, 4, 1, "delta", None, "y"), (1, 5, 0, "edit", None, "hey"),
        (2, 0, 0, None, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "xy")], 2: [("", "")]}
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_jaccard_join(small, odd, empty):
    for df in (small, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
        assert got == brute.components(pairs_of(df))
    assert jaccard_join.jaccard_components(odd).count() == odd.count() and jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_join_with_large_groups(spark, monkeypatch):
    """Families of near copies around an original, chains, and a passage that many documents share."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    r = random.Random(3)
    rows, original, passage = [], prose(9, 120).split(), prose(10, 40)
    for i in range(90):
        w = list(original)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = prose(11, 100).split()
    for i in range(100, 130):
        chain = [*chain[2:], f"c{i}", f"d{i}"]
        rows.append((i, " ".join(chain)))
    rows += [(i, passage + " " + prose(i, r.choice([3, 8, 12, 20, 60]))) for i in range(200, 260)]
    rows += [(i, " ".join(["tiny", "doc", *["of"] * (i % 4), f"n{i % 7}"])) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(df).collect()}
    assert got == brute.components(rows)
    kept = {x["doc_id"] for x in jaccard_join.one_of_each(df).collect()}
    assert kept == {c for _, c in brute.components(rows).values()}


def test_jaccard_join_links_to_sets_resolved_in_another_batch(spark):
    """Families of 20 in one batch; in another, a set that links to an off-centre member only."""
    near, apart, want = [], [], {}
    for j in range(6, 26):
        original = [f"f{j}w{i}" for i in range(4 * j + 5)]
        family = [original, original[:-1], *[[*original, f"f{j}e{i}"] for i in range(18)], original[j:-1]]
        rows = [(100 * j + i, " ".join(w)) for i, w in enumerate(family)]
        near += rows[:20]
        apart += rows[20:]
        want |= brute.components(rows)
    df = spark.createDataFrame(spark.sparkContext.parallelize([near, apart], 2).flatMap(lambda x: x), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(df).collect()}
    assert got == want and all(want[100 * j + 20][1] == 100 * j for j in range(6, 26))


def test_jaccard_join_does_not_depend_on_partitions(spark):
    """Families of two wings of 16 in one partition, and in another a short set that links to one wing at most."""
    here, there, want = [], [], {}
    for j in range(40):
        base = [f"g{j}w{i}" for i in range(90)]
        family = [(1000 * j + i, " ".join([*base[: 80 + i // 16], f"g{j}u{i}"])) for i in range(32)]
        family.append((1000 * j + 40, " ".join(base[:62])))
        here += family[:32]
        there += family[32:]
        want |= brute.components(family)
    schema = "doc_id long, text string"
    both = spark.createDataFrame(spark.sparkContext.union([spark.sparkContext.parallelize(x, 1) for x in (here, there)]), schema)
    for df in (both, both.repartition(1), both.repartition(7)):
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(df).collect()} == want


def test_signatures_meet_for_every_link():
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 4, 6, 9, 14, 25, 60, 200):
        for _ in range(40):
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            y = x.copy()
            for _ in range(rng.integers(0, size // 4 + 2)):
                y = y[np.arange(len(y)) != rng.integers(len(y))] if rng.random() < 0.5 and len(y) > 1 else np.unique(np.append(y, rng.integers(0, 2**63, dtype=np.uint64)))
            both = len(np.intersect1d(x, y))
            hot = np.sort(rng.choice(x, len(x) // 2, replace=False))
            if 4 * both >= 3 * (len(x) + len(y) - both):
                assert len(np.intersect1d(jaccard_join.signatures(x, hot), jaccard_join.signatures(y, hot)))
            assert jaccard_join.least_differences(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= len(np.setxor1d(x, y))


def test_quality(small, odd, empty):
    for df in (small, odd):
        rows = quality.quality(df).collect()
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
        assert got == Counter((d, *brute.quality_base(t)) for d, t in pairs_of(df))
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in quality.quality(small).filter("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(small).collect()} == kept
    assert quality.quality(empty).count() == 0


def test_quality_verdict_follows_the_labels(spark, small):
    rows = quality.quality(small).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_quality_keeps_languages_of_a_small_share(spark):
    """A clean language of another script, under 1/200 of the documents: with words enough for a reference, and without."""
    r = random.Random(5)
    common = {"la": ["the", "of", "and", "to"], "ru": ["\u0438", "\u0432", "\u043d\u0435", "\u043d\u0430"], "el": ["\u03ba\u03b1\u03b9", "\u03c4\u03bf", "\u03bd\u03b1"]}
    first = {"la": ord("a"), "ru": 0x430, "el": 0x3B1}

    def text(lang, n):
        word = lambda: "".join(chr(first[lang] + r.randrange(20)) for _ in range(r.randrange(3, 8)))
        return " ".join(r.choice(common[lang]) if r.random() < 0.4 else word() for _ in range(n))

    junk = " ".join("#%" + "".join(r.choice("#*$%&|<>0123456789") for _ in range(6)) for _ in range(90))
    rows = [(i, text("la", 80), "la") for i in range(2000)]
    rows += [(3000 + i, text("ru", 500), "ru") for i in range(6)] + [(4000, text("el", 100), "el"), (5000, junk, "la"), (5001, junk, "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in quality.quality(df).filter("kept").collect()}
    assert {*range(3000, 3006), 4000} <= kept and not kept & {5000, 5001} and len(kept) == 2007
    assert {x["doc_id"] for x in quality.keep_good(df).collect()} == kept


def test_quality_verdict_against_brute_force(small):
    """Distances, shares of common words and the verdict, from exact counts over the whole table; alike for any partitions."""
    want = brute.quality_verdicts([(r["doc_id"], r["text"], r["lang"]) for r in small.collect()])
    for df in (small.repartition(1), small.repartition(9)):
        for r in quality.quality(df).collect():
            kept, distances = want[r["doc_id"]]
            assert r["kept"] == kept
            assert [r["class_distance"], r["word_distance"], r["share_distance"]] == (pytest.approx(distances) if distances else [None] * 3)


def test_quality_rejects_texts_without_common_words(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(r.choice(["of", "the", "to", "in"]) if r.random() < 0.2 else word() for _ in range(90)), "en") for i in range(300)]
    rows += [(1000, " ".join(word() for _ in range(90)), "en"), (1001, " ".join(word() for _ in range(40)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x["doc_id"] for x in quality.quality(df).filter("not kept").collect()} == {1000}


def test_word_distances_are_those_of_whole_histograms():
    import numpy as np

    triples = [(0, b"a", 0.3), (0, b"b", 0.2), (1, b"b", 0.1), (1, b"c", 0.4)]
    whole = np.array([[0.3, 0.2, 0, 0.5], [0, 0.1, 0.4, 0.5]])
    refs = quality.References(["x", "y"], np.ones((2, 9)) / 9, triples, np.array([0.5, 0.5]))
    for found in ([1, 2, 3, 4], [0, 0, 0, 5], [0, 0, 7, 0]):
        p = np.array(found, float)
        assert np.allclose(refs._word_distances(p / p.sum()), quality.js_distance(p, whole))


def test_js_distance():
    import numpy as np

    assert quality.js_distance(np.array([1.0, 0]), np.array([[0, 1.0], [1, 0]])).tolist() == [1.0, 0.0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert ordered(map(tuple, got)) == ordered(want.fetchall())


def test_vocabulary_file_is_read_by_path_only():
    with open(VOCABULARY, encoding="utf-8") as file:
        assert json.load(file)["model"]["end_of_word_suffix"] == "</w>"
