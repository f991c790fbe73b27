import hashlib
import random
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from analystry.llm import bpe, minhash, mixing, passages, pii, toxicity
from analystry.llm.chunking import chunk_bounds
from analystry.llm.queries import tokenizer_file

STRANGE = [(None, "no id"), (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (4, "one two"), (5, "ünïcödé \u200b 漢字 🙂" * 50)]


def test_chunks_resist_insertions():
    data = np.random.default_rng(0).integers(32, 127, 60_000, dtype=np.uint8).tobytes()
    cut = lambda d: [d[a:b] for a, b in zip([0, *chunk_bounds(d, 64, 6, 1024)], chunk_bounds(d, 64, 6, 1024))]
    plain, shifted = cut(data), cut(data[:1000] + b"inserted" + data[1000:])
    assert b"".join(plain) == data and all(64 <= len(c) <= 1024 for c in plain[:-1])
    assert len(set(plain) - set(shifted)) <= 4
    assert chunk_bounds(b"", 64, 6, 1024) == [] and chunk_bounds(b"ab", 64, 6, 1024) == [2]


@pytest.fixture(scope="module")
def encoder():
    return bpe.ChunkEncoder(tokenizer_file())


def by_library(encoder, data):
    return encoder.tokenizer.encode(data.decode(), add_special_tokens=False).ids


def test_faster_encoder_equals_the_library(encoder):
    every = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250))]
    draw = random.Random(6)
    for text in ["".join(every), " ".join(every), *["".join(draw.choices(every, k=80)) for _ in range(600)], *["".join(draw.choices(every[:60] + [" "] * 30, k=80)) for _ in range(300)]]:
        assert encoder.fast is not None and encoder.whole(text.encode()).tolist() == by_library(encoder, text.encode())


def test_encoding_equals_whole_texts(encoder):
    draw = random.Random(8)
    alphabet = ["word", " ", "  ", "\n", "\n\n ", "<|endoftext|>", "'s", "漢字", "é", "\u3000", "\xa0", "123", "...", "🙂", "<|endo", "ftext|>", "\r\n", "\t"]
    for _ in range(150):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 3000)))
        data = text.encode()
        assert encoder.encode(data).tolist() == by_library(encoder, data)
        assert encoder.decode(encoder.encode(data)) == encoder.tokenizer.decode(encoder.whole(data).tolist(), skip_special_tokens=False)
    for text in ["a" * 50_000, " " * 50_000, "漢" * 20_000, "x " * 30_000, "<|endoftext|>" * 3000]:
        assert encoder.encode(text.encode()).tolist() == by_library(encoder, text.encode())


def test_encoded_documents(documents, encoder, prose):
    shared = prose(1, 1500)
    rows = STRANGE + [(k, prose(k, 300) + " " + shared) for k in range(10, 20)]
    got = bpe.encode_documents(documents(rows, extra=True), tokenizer_file(), digests_only=False).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), by_library(encoder, (t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded_sha256"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in got)
    assert bpe.repeated_chunks(documents(rows)).count() > 0
    assert bpe.encode_documents(documents([]), tokenizer_file()).count() == 0


def test_another_kind_of_vocabulary(documents, prose):
    path = tokenizer_file("word_bpe_49k.json")
    library = bpe.ChunkEncoder(path).tokenizer
    rows = STRANGE + [(k, prose(k, 400) + "  It's HERE,\n\n42 " + prose(1, 900)) for k in range(10, 16)]
    got = {str(r["doc_id"]): r for r in bpe.encode_documents(documents(rows), path, digests_only=False).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[str(i)]["ids"] == ids
        assert got[str(i)]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_chunks_of_two_holders_are_shared(documents, prose):
    shared = prose(1, 3000)
    found = bpe.repeated_chunks(documents([(k, prose(k, 200) + " " + shared) for k in (10, 11)]))
    assert found.count() > 5 and {r["times"] for r in found.collect()} == {2}


def test_clashing_names_stay(documents, spark):
    clash = {c: F.lit(7).alias(c) for c in ("mixed_id", "times", "gone", "again", "cut_id", "id", "row", "copy", "cuts", "kept")}
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "x y z u v w"), (4, "x y z u v w")]).select("*", *clash.values())
    for out in (mixing.mixed_rows(docs), minhash.one_of_each(docs), passages.without_repeats(docs)):
        assert out.columns == docs.columns and {r["copy"] for r in out.collect()} == {7}
    assert sorted(r["doc_id"] for r in minhash.one_of_each(docs).collect()) == [1, 3, 4]


def test_pipeline_end_to_end(spark, tmp_path):
    draw, given = random.Random(5), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs, seen = given, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out-{name}")
        seen.append((name, {r["doc_id"]: r for r in before.collect()}, docs.collect()))
    stages = {name: (before, after) for name, before, after in seen}
    before, after = stages["toxicity"]
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(given, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(i for i in before if not scored[i]) and 0 < len(after) < len(before)
    before, after = stages["near_duplicates"]
    want = brute.near_duplicates([(i, r["text"]) for i, r in before.items()], corpus_pipeline.NEAR_PERCENT)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, w in want.items() if w[2])
    before, after = stages["personal_data"]
    assert {r["doc_id"]: r["text"] for r in after} == {i: r["text"] if r["text"] is None else pii.mask(r["text"]) for i, r in before.items()}
    before, after = stages["source_mix"]
    assert all(tuple(r) == tuple(before[r["doc_id"]]) for r in after) and max(Counter(r["doc_id"] for r in after).values()) <= 3
    words = lambda rows: Counter({s: sum(len((r["text"] or "").encode().split()) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    sizes = words(before.values())
    goals = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    got = words(after)
    longest = max(len((r["text"] or "").split()) for r in before.values())
    assert all(abs(got[s] - goals[s]) <= 3 * longest + 0.1 * goals[s] for s in goals)
    before, after = stages["bpe_tokens"]
    library = bpe.ChunkEncoder(tokenizer_file()).tokenizer
    for r in draw.sample(after, 40):
        ids = library.encode(before[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after))


def test_no_labels_keep_the_corpus(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(documents([(1, "a"), (2, None)]), none).count() == 2


def test_personal_data_agrees_with_plain_patterns(documents):
    draw = random.Random(2)
    bits = ["a@b.co", "x.y@z", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (980) 555-6268", "+", "12", " ", "-", "(", "é", "7", "\n", "001.02.3.255.6"]
    rows = STRANGE + [(k, "".join(draw.choice(bits) for _ in range(draw.randint(1, 40)))) for k in range(100, 700)]
    rows += [(800, "9" * 100_000), (801, "a" * 100_000 + "@"), (802, "+1" + "(" * 100_000), (803, "1." * 50_000), (804, "@a." * 30_000)]
    got = {(r["doc_id"], (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"]) for r in pii.find_personal_data(documents(rows, extra=True)).collect()}
    assert got == {(i, *brute.personal_data(t)) for i, t in rows if i not in (800, 801, 802, 803, 804)} | {g for g in got if g[0] in (800, 801, 802, 803, 804)}
    assert len(got) == len({(i, t) for i, t in rows}) and pii.find_personal_data(documents([])).count() == 0


@pytest.mark.parametrize("text, found", [
    ("mail john at example dot com now", ["john at example dot com"]), ("bob [at] site (dot) org.", ["bob [at] site (dot) org"]),
    ("j\u043ehn@ex\u0430mple.com", ["j\u043ehn@ex\u0430mple.com"]), ("ip １９２.１６８.０.１ end", ["１９２.１６８.０.１"]),
    ("a\u200b@b\u200b.com", ["a\u200b@b\u200b.com"]), ("call plus four nine three zero one two three four five six", ["plus four nine three zero one two three four five six"]),
    ("we look at the dot on the map", []), ("one two three", []), ("x@y.com at 1.2.3.4", ["x@y.com", "1.2.3.4"]),
])
def test_disguises(text, found):
    assert [text[a:b] for a, _, b in pii.all_spans(text)[1]] == found
    assert set(pii.find_spans(text)) <= set(pii.all_spans(text)[1])


@pytest.mark.parametrize("text, found", [
    ("to anna at firma dot pl.", ["anna at firma dot pl"]), ("anna at mail dot ru, now", ["anna at mail dot ru"]), ("anna [at] firma dot nl", ["anna [at] firma dot nl"]),
    ("ask anna at b dot co dot jp now", ["anna at b dot co dot jp"]), ("mail john dot smith at example dot com", ["john dot smith at example dot com"]),
    ("write anna at example.com.", ["anna at example.com"]), ("j dot r [dot] t (at) a.b dot museum", ["j dot r [dot] t (at) a.b dot museum"]), ("anna@firma dot pl", ["anna@firma dot pl"]),
    ("anna at a dot b dot c dot d dot e dot f dot g dot pl", ["anna at a dot b dot c dot d dot e dot f dot g dot pl"]), ("\u0430nna at f\u0456rma dot pl", ["\u0430nna at f\u0456rma dot pl"]),
    ("\U0001d423\U0001d428\U0001d421\U0001d427@ex.com!", ["\U0001d423\U0001d428\U0001d421\U0001d427@ex.com"]), ("call +\u096a\u096f \u0969\u0966\u0967 \u0968\u0969\u096a \u096b\u096c\u096d\u096e", ["+\u096a\u096f \u0969\u0966\u0967 \u0968\u0969\u096a \u096b\u096c\u096d\u096e"]),
    ("host at 10 dot zero dot zero dot one", ["10 dot zero dot zero dot one"]), ("look at the dot in it, at one dot two", []), ("arrive at home. Then go", []),
])
def test_whole_addresses_in_words(text, found):
    assert [text[a:b] for a, _, b in pii.all_spans(text)[1]] == found
    assert not found or all(f not in pii.mask(text) for f in found)


def test_masking(documents):
    out = {r["doc_id"]: r for r in pii.masked(documents([(1, "to a@b.co, 1.2.3.4"), (2, None), (3, "clean"), (None, "a@b.co")], extra=True)).collect()}
    assert out[1]["text"] == "to <EMAIL>, <IP>" and out[1]["n_chars"] == 16 and out[2]["text"] is None and out[3]["text"] == "clean" and out[None]["digest"] == "x"


def near_rows(prose):
    draw = random.Random(4)
    rows = [(k, prose(k, 60)) for k in range(100, 130)]
    for group in range(6):
        words = prose(1000 + group, 150).split()
        for copy in range(12):
            changed = list(words)
            for _ in range(draw.choice([0, 0, 1, 2, 3, 4])):
                changed[draw.randrange(len(changed))] = f"new{draw.randrange(10**6)}"
            rows.append((200 + 20 * group + copy, ("  ".join(changed)).upper() if copy % 3 == 0 else " ".join(changed)))
    return rows + [(900, "a b c d"), (901, "A b\tc\nd"), (902, "a b c d e"), (903, "x " * 40_000), (904, "x " * 10), (905, None), (906, " "), (907, "b a")]


def test_near_duplicates(documents, prose):
    rows = near_rows(prose)
    want = brute.near_duplicates(rows)
    docs = documents(rows + rows[:3], extra=True)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 3
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert len({c for _, c, _ in want.values()}) < len(rows) - 20
    kept = minhash.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])
    assert kept.columns == docs.columns


def test_near_duplicates_in_many_blocks(documents, prose, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = near_rows(prose)
    assert {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(documents(rows)).collect()} == brute.near_duplicates(rows)


def test_bits_count_like_sets(monkeypatch):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(300, 400), replace=False), rng.integers(0, 1 << 62, 20, dtype=np.uint64)])) for _ in range(30)]
    left, right = np.triu_indices(30, 1)
    want = [minhash.similar(sets[a], sets[b], 75) for a, b in zip(left, right)]
    assert any(want) and not all(want) and minhash.similar_pairs(sets, left, right, 75).tolist() == want
    monkeypatch.setattr(minhash, "COLUMNS", 128)
    assert minhash.similar_pairs(sets, left, right, 75).tolist() == want
    monkeypatch.setattr(minhash, "FEW_PAIRS", 10**6)
    assert minhash.similar_pairs(sets, left, right, 75).tolist() == want


def test_near_duplicates_of_nothing(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(documents([(None, "a b"), (None, "a b")])).collect()] == [(None, 1, None, False)] * 2
    assert minhash.one_of_each(documents([(None, "a"), (1, None), (2, "")])).count() == 3


def test_posterior_bounds_rise():
    least = minhash.least_matches(85)
    assert list(least) == sorted(least) and least[-1] < 0.85 * minhash.HASHES
    assert minhash.least_matches(85, 1e-2)[-1] > least[-1]


def test_repeated_passages(documents, prose):
    passage = prose(77, 55)
    rows = [(k, f"{prose(k, 40 + k)} {passage} {prose(500 + k, 30)}") for k in range(8)] + [(k, prose(k, 200)) for k in range(50, 60)]
    rows += [(90, None), (91, ""), (92, prose(92, 30_000)), (None, passage), (93, "short line here.\nshort line here."), (94, "short line here.")]
    docs = documents(rows, extra=True)
    found = passages.repeated_passages(docs).collect()
    text = {i: t for i, t in rows}
    assert {r["doc_id"] for r in found} == set(range(8))
    assert all(text[r["doc_id"]][r["start"]:r["end"]] in passage + " " or passage.startswith(text[r["doc_id"]][r["start"]:r["end"]][:20].strip()) or r["words"] >= 25 for r in found)
    assert [r["doc_id"] for r in found if r["kept"]] == [0] and {r["first_doc_id"] for r in found} == {0}
    left = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs).collect()}
    assert left[0] == text[0] and left[50] == text[50] and left[90] is None and len(left[3]) < len(text[3]) - 100 and len(left) == len(text)
    assert passages.repeated_passages(documents([])).count() == 0


def test_every_repeated_chunk_stays_in_its_first_document(documents, prose):
    shared, rest = prose(301, 60), prose(302, 120)
    line = prose(303, 40)
    rows = [(1, shared), (5, f"{shared} {rest}"), (9, f"{shared} {rest}")]
    rows += [(20, f"{prose(304, 50)} {line} {prose(305, 50)}")] + [(k, f"{prose(306, 80)} {line} {prose(307, 80)}") for k in (22, 24, 26)]
    rows += [(k, prose(308, 90)) for k in (30, 31)]
    left = {r["doc_id"]: r["text"] for r in passages.without_repeats(documents(rows)).collect()}
    assert left[1] == shared and rest[60:] in left[5] and len(left[9]) < 100
    assert prose(306, 80) in left[22] and prose(307, 80)[60:] in left[22] and max(len(left[24]), len(left[26])) < 150
    assert (left[30], left[31]) == (prose(308, 90), "")
    first = {}
    for doc_id, text in rows:
        _, starts, ends, _ = passages.text_chunks(text)
        for a, b in zip(starts, ends):
            first.setdefault(text[a:b], doc_id)
    assert all(chunk in left[doc_id] for chunk, doc_id in first.items())
    marks = {(r["doc_id"], r["kept"]) for r in passages.repeated_passages(documents(rows)).collect()}
    assert {(5, False), (5, True), (22, False), (22, True), (9, False), (24, False)} <= marks and (9, True) not in marks


def test_pipeline_links_from_eighty_hundredths(spark, documents, prose):
    words = prose(400, 204).split()
    changed = [w if k not in (40, 100, 120, 160) else f"new{k}" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, prose(401, 100))]
    shared = len(brute.shingles(rows[0][1]) & brute.shingles(rows[1][1]))
    assert 0.80 <= shared / (400 - shared) < 0.85
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_bands_keep_the_miss_probability():
    assert (minhash.bands(85), minhash.BANDS, minhash.bands(80)) == (24, 24, 35)
    assert all((1 - (p / 100) ** minhash.ROWS_PER_BAND) ** minhash.bands(p) <= minhash.MISS for p in (75, 80, 85, 90))
    assert minhash.signature(np.arange(9, dtype=np.uint64), 175)[:120].tolist() == minhash.signature(np.arange(9, dtype=np.uint64)).tolist()
