"""Operators against brute force, on awkward and on generated tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docflow.llm import avi, bpe_tree, digest_index, hilbert, jpeg, language_id, license_scan, lsh_forest, mixing, token_store
from docflow.operators import components
from docflow.plans.staging import new_path
from tests.llm.cases import awkward, clashing, prose, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return df.collect()


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


OPERATORS = {
    "op1": hilbert.op1_hilbert_shards,
    "op2": language_id.op2_language_id,
    "op4": avi.op4_avi_media,
    "op5": license_scan.op5_license_scan,
    "op6": bpe_tree.op6_bpe_tree,
    "op7": lsh_forest.op7_lsh_forest,
    "op8": digest_index.op8_exact_dedup,
    "op9": token_store.op9_token_store,
    "op10": mixing.op10_systematic_mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_give_a_row_each_and_other_columns_do_not_matter(spark, name):
    df = awkward(spark)
    plain = sorted(map(str, rows_of(OPERATORS[name](df))))
    assert len(plain) == df.count()
    assert plain == sorted(map(str, rows_of(OPERATORS[name](clashing(df)))))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](table(spark, []))
    assert out.count() == 0 and "doc_id" in out.columns


# Hilbert


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 5), (3, 3), (4, 2)])
def test_hilbert_curve_visits_each_cell_once_by_unit_steps(spark, dims, bits):
    from pyspark.sql import functions as F

    side = 1 << bits
    points = spark.range(side**dims).select(*[F.expr(f"cast(floor(id / {side**k}) % {side} as int) AS c{k}") for k in range(dims)])
    cells = [F.col(f"c{k}") for k in range(dims)]
    path = [tuple(r) for r in points.withColumn("h", hilbert.hilbert_index(cells, bits)).orderBy("h").collect()]
    assert [p[-1] for p in path] == list(range(side**dims))
    assert all(sum(abs(a - b) for a, b in zip(p[:-1], q[:-1])) == 1 for p, q in zip(path, path[1:]))


def test_shards_are_runs_of_the_order_with_counts_one_apart(spark, sf):
    docs = documents(spark, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = rows_of(hilbert.op1_hilbert_shards(docs))
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    by_shard = defaultdict(list)
    for r in found:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "rows", None)
        by_shard[r.shard].append((r.slot, r.hilbert, r.doc_id))
    assert all([s for s, _, _ in sorted(v)] == list(range(len(v))) for v in by_shard.values())
    order = [x[1:] for s in range(16) for x in sorted(by_shard[s])]
    assert order == sorted(order)


def test_quantile_cells_follow_the_order_of_values(spark):
    rng = random.Random(3)
    values = [rng.choice(["a", "b", "hot", "hot", "hot", "hot", "z", None, f"v{rng.randrange(40)}"]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    bounds = hilbert.quantile_bounds(df, "v", 16)
    cells = {r.v: r.c for r in df.select("v", hilbert.quantile_cell(df.v, bounds).alias("c")).distinct().collect()}
    known = sorted(v for v in cells if v is not None)
    assert cells[None] == 0 and [cells[v] for v in known] == sorted(cells[v] for v in known) and max(cells.values()) >= 14
    order, told = sorted(v for v in values if v is not None), {}
    for k, v in enumerate(order):
        told.setdefault(v, []).append(k)
    assert all(cells[v] == (own[0] + len(own) / 2) * 16 // len(order) for v, own in told.items())
    assert hilbert.quantile_bounds(df.filter("v IS NULL"), "v", 16) == []


def test_ranges_of_shards_prune_on_every_dimension(spark, sf):
    """Filters on one dimension read clearly fewer shards, by the recorded ranges, than of shuffled rows."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    path = new_path(spark, "shards-test")
    ranges = {r.shard: r for r in hilbert.write_shards(docs, path).collect()}
    rows = docs.collect()
    size = lambda r: len((r.text or "").encode()) + 1
    written = spark.read.parquet(f"{path}/data")
    assert sorted(written.drop("shard").select(docs.columns).collect()) == sorted(rows)
    for r in written.collect():
        own = ranges[r.shard]
        assert own.min_source <= r.source <= own.max_source and own.min_lang <= r.lang <= own.max_lang and own.min_size <= size(r) <= own.max_size
    read = lambda c, v: sum(r[f"min_{c}"] <= v <= r[f"max_{c}"] for r in ranges.values())
    mean = lambda c, values: sum(read(c, v) for v in values) / len(values)
    sizes = sorted(map(size, rows))
    assert mean("source", sorted({r.source for r in rows})) <= 9
    assert mean("lang", ["de", "es", "fr"]) <= 9 and mean("size", [sizes[len(sizes) * k // 20] for k in range(20)]) <= 10
    with pytest.raises(ValueError):
        hilbert.write_shards(docs.union(docs.limit(1)), path + "2")


# Language


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.collect()}
    found = rows_of(language_id.op2_language_id(docs))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_never_uses_held_out_labels_and_knows_und(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, prose(i, 30), "wrong" if i in held else "right") for i in range(200)] + [(1000, None, "right"), (1001, "12 !?", "right")]
    found = {r.doc_id: r for r in rows_of(language_id.op2_language_id(table(spark, rows)))}
    assert {r.lang_pred for i, r in found.items() if i < 1000} == {"right"}
    assert found[1000].lang_pred == found[1001].lang_pred == "und" and found[1000].score == 0
    kept = language_id.keep_identified(table(spark, rows))
    assert kept.count() == 200 and kept.columns == table(spark, rows).columns


def test_presence_kernel_against_sets():
    params = language_id.KernelParams()
    texts = [b"abc abd", b"abc", b"", b"zzz zz"]
    flags = language_id.gram_presence(texts, params)
    together = [language_id.gram_presence([t], params)[0] for t in texts]
    assert (flags == np.stack(together)).all()
    values = language_id.kernel(flags.astype(np.float32), flags.astype(np.float32))
    assert np.allclose(np.diag(values), 1) and values[0, 1] > values[0, 3]


# Media


@pytest.mark.parametrize("text", [b"", b"x", b"\xff" * 192, bytes(range(256)) * 40, b"a" * 6144, b"b" * 6145])
def test_text_survives_the_container(text):
    media = avi.store_text(text)
    movie, clips, payload = avi.analyse(media, with_payload=True)
    assert payload == avi.pad(text) and len(payload) % 192 == 0 and payload
    assert clips[0].start_frame == 0 and clips[-1].end_frame == len(movie.frames)


def test_symbol_by_symbol_decoding_equals_the_quick_one(monkeypatch):
    data = jpeg.store(random.Random(1).randbytes(192 * 5), 3, 2)
    quick = jpeg.decode(data).coefficients
    monkeypatch.setattr(jpeg, "_DATA_BYTES", -1)
    assert all((a == b).all() for a, b in zip(quick, jpeg.decode(data).coefficients))


def grey(level, width=16, height=16):
    """A grey frame of one value: DC only, one component, no restarts."""
    value = round((level - 128) * 8)
    size = abs(value).bit_length()
    bits = format(size, "04b") + (format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else "") + "0"
    rest = "0000" + "0"  # the same DC again
    units = (width // 8) * (height // 8)
    stream = bits + rest * (units - 1)
    stream += "1" * (-len(stream) % 8)
    data = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00")
    dc = bytes([0x00, 0, 0, 0, 12, *[0] * 12]) + bytes(range(12))
    ac = bytes([0x10, 1, *[0] * 15]) + b"\x00"
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + b"\x01" * 64)
    head += jpeg._segment(0xC0, bytes([8, 0, height, 0, width, 1, 1, 0x11, 0]))
    head += jpeg._segment(0xC4, dc) + jpeg._segment(0xC4, ac) + jpeg._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    return head + data + b"\xff\xd9"


def test_grey_frames_and_shots(spark):
    frame = jpeg.decode(grey(200))
    assert frame.luma().shape == (16, 16) and abs(int(frame.luma().mean()) - 200) <= 1
    levels = [40] * 5 + [200] * 7 + [90] * 4
    media = avi.write_avi([grey(v) for v in levels], 16, 16, rate=10)
    bare = media[: media.index(b"idx1")]
    bare = bare[:4] + (len(bare) - 8).to_bytes(4, "little") + bare[8:]
    for data in (media, bare):
        _, clips, _ = avi.analyse(data)
        assert [(c.start_frame, c.end_frame, c.start_s, c.end_s) for c in clips] == [(0, 5, 0.0, 0.5), (5, 12, 0.5, 1.2), (12, 16, 1.2, 1.6)]
    found = rows_of(avi.avi_clips(spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"junk")), (4, bytearray(media[:300]))], "id long, avi binary")))
    assert sum(r.id == 1 for r in found) == 3
    assert all(r.error for r in found if r.id != 1) and {r.id for r in found} == {1, 2, 3, 4}


def test_frames_of_further_segments_and_rec_lists():
    frames = [avi._chunk(b"00dc", grey(v)) for v in (40, 90, 200)]
    plain = avi.write_avi([grey(40)], 16, 16)
    head = plain[12 : plain.index(b"LIST", plain.index(b"strf"))]
    recs = avi._list(b"rec ", frames[0] + avi._list(b"rec ", frames[1])) + frames[2]
    more = b"".join(avi._chunk(b"RIFF", b"AVIX" + avi._list(b"movi", body)) for body in (recs, frames[1]))
    walked = avi._chunk(b"RIFF", b"AVI " + head + avi._list(b"movi", recs))
    for data, levels in ((walked, [40, 90, 200]), (plain + more, [40, 40, 90, 200, 90]), (walked + more, [40, 90, 200] * 2 + [90])):
        assert [data[a:b] for a, b in avi.read_avi(data).frames] == [grey(v) for v in levels]
    with pytest.raises(avi.AviError):
        avi.read_avi((plain + more)[:-8])


def test_features_tell_late_clips_apart():
    def clips(*ends):
        return [avi.Clip(a, b, a / 25, b / 25, 100.0, 0.0) for a, b in zip((0, *ends), ends)]

    movie, early = avi.Movie(25.0, 16, 16, [(0, 1)] * 60), tuple(range(2, 36, 2))
    assert avi.feature(movie, clips(*early, 40, 60)) != avi.feature(movie, clips(*early, 50, 60))
    assert avi.feature(movie, clips(*early, 40, 60)) == avi.feature(movie, clips(*early, 40, 60))


def test_media_digests(spark):
    df = awkward(spark)
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    for r in rows_of(avi.op4_avi_media(df)):
        payload = avi.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


# Licences


@pytest.mark.parametrize(
    "source,choices",
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0", ["apache-2.0", "mit"]),
        ("a OR b AND c", ["a", "b+c"]),
        ("(a OR b) AND c", ["a+c", "b+c"]),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR x", ["gpl-2.0+ with classpath-exception-2.0", "x"]),
        ("MIT */ int main()", ["mit"]),
        ("MIT OR", ["mit"]),
    ],
)
def test_licence_expressions(source, choices):
    found = license_scan.evaluate(license_scan.tokens(source))
    assert sorted("+".join(sorted(c)) for c in found.choices) == choices


@pytest.mark.parametrize("source", ["", "AND x", "(a", "((a OR b)", "a WITH (b OR c)"])
def test_broken_expressions(source):
    with pytest.raises(license_scan.ExpressionError):
        license_scan.evaluate(license_scan.tokens(source))


def test_many_choices_stay_bounded():
    found = license_scan.evaluate(license_scan.tokens(" AND ".join(f"(a{i} OR b{i})" for i in range(20))))
    assert len(found.names) == 40 and len(found.choices) <= 256


def satisfied(formula, held):
    """Whether the licences held satisfy a formula of and, or and parentheses."""
    return eval(" ".join(t if t in ("and", "or") else re.sub(r"[a-z0-9]+", lambda m: str(m[0] in held), t) for t in formula.split()))


def test_choices_are_least_sets_or_the_exact_formula():
    found = {k: license_scan.evaluate(license_scan.tokens(s)) for k, s in {
        "absorbed": "a OR a AND b", "merged": " AND ".join(["(a OR b OR c)"] * 20), "factors": " AND ".join(f"(a{i} OR b{i})" for i in range(9)), "wide": " OR ".join(f"x{i}" for i in range(257)),
    }.items()}
    assert str(found["absorbed"]) == "a" and str(found["merged"]) == "a|b|c"
    for taken in range(512):
        held = {f"{'ab'[taken >> i & 1]}{i}" for i in range(9)}
        assert satisfied(str(found["factors"]), held) and not satisfied(str(found["factors"]), held - {"a0", "b0"})
    assert all(satisfied(str(found["wide"]), {f"x{i}"}) for i in range(257)) and not satisfied(str(found["wide"]), set())


def test_phrases_against_word_lists(spark, sf):
    extra = ["Apache License cc by cc by", "CC-BY, apache\nlicense; MIT license mit license", "SPDX-License-Identifier: (MIT OR Apache-2.0)\nx", "CC BYé", "gnu general public license" * 2]
    df = documents(spark, sf).select("doc_id", "text").union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in rows_of(license_scan.op5_license_scan(df)):
        words = pattern.findall(lower(texts[r.doc_id]))
        places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        labels = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        if r.doc_id == 10_002:
            assert r.labels == "apache,spdx:apache-2.0,spdx:mit" or r.labels == "spdx:apache-2.0,spdx:mit"


# Byte-level BPE


def test_tree_equals_the_library_on_random_texts():
    vocabulary = bpe_tree.public_vocabulary()
    rng = random.Random(5)
    parts = ["a", "b", "'", "s", "ll", " ", "  ", "\n", "1", "2", "!", "é", "漢", "字", "。", "\x1c", "\x85", "　", "é", "😀", "t", "re", "A", "-"]
    tree = bpe_tree.TreeCoder(vocabulary)
    for _ in range(3000):
        tree.leaf, tree.window, tree.run, tree.piece_leaf = rng.choice([2, 3, 8]), rng.choice([2, 4]), rng.choice([4, 6, 4096]), rng.choice([4, 8])
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = tree.encode(text)
        assert ids == tree.base.encode_ordinary(text) and tree.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000 + " x", "!" * 20_000, " " * 20_000 + "x", prose(3, 8000)])
def test_tree_on_long_runs(text):
    tree = bpe_tree.TreeCoder(bpe_tree.public_vocabulary())
    ids = tree.encode(text)
    assert ids == tree.base.encode_ordinary(text) and tree.decode(ids) == text.encode()


def test_bpe_digests(spark):
    df = awkward(spark)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    base = bpe_tree.TreeCoder(bpe_tree.public_vocabulary()).base
    for r in rows_of(bpe_tree.op6_bpe_tree(df)):
        ids = base.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.ids for r in rows_of(bpe_tree.encode_documents(df, bpe_tree.public_vocabulary()))}[1] == base.encode_ordinary(texts[1])


# Near duplicates


def brute_components(rows, width):
    sets = []
    for _, text in rows:
        words = WORDS.findall(lower(text))
        n = min(width, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[k][0]: (len(sets[k]), rows[find(k)][0]) for k in range(len(rows))}


def near_copies(seed):
    """Groups of copies with some words changed, in clouds and chains, and a common passage."""
    rng, texts = random.Random(seed), []
    passage = prose(99, 60)
    for g in range(25):
        base = prose(seed * 1000 + g, rng.choice([5, 40, 120])).split()
        if g % 4 == 0:
            base += passage.split()
        for k in range(rng.choice([1, 1, 2, 5, 30])):
            words = base if k == 0 or g % 2 else last
            words = [w if rng.random() > 0.04 else f"new{rng.random()}" for w in words]
            last = words
            texts.append(" ".join(words) if rng.random() > 0.2 else " ".join(words).upper().replace("É", "é"))
    rng.shuffle(texts)
    return list(enumerate([*texts, "", "one", "ONE", " ", None]))


@pytest.mark.parametrize("width,block", [(2, 256), (2, 8), (5, 16)])
def test_near_components_against_brute_force(spark, width, block):
    rows = near_copies(width + block)
    expected = brute_components(rows, width)
    params = lsh_forest.ForestParams(width=width, block=block)
    found = rows_of(lsh_forest.near_components(spark.createDataFrame(rows, "doc_id long, text string"), params))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_components_of_documents(spark, sf):
    docs = documents(spark, sf)
    expected = brute_components([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows_of(lsh_forest.op7_lsh_forest(docs))} == expected


def test_ranges_take_no_candidate_away(spark):
    """A crowded region in one range and in many: the latter has every edge of the former."""
    rng = random.Random(8)
    base = [rng.randbytes(1) for _ in range(lsh_forest.LEVELS)]
    params = lsh_forest.ForestParams(trees=2, head=1)
    rows = []
    for i in range(3000):
        low = b"".join(b if rng.random() < 0.7 else rng.randbytes(1) for b in base)
        rows.append((i, [7, rng.choice([7, 8])], bytearray(low + low[:2] + b"x")))
    schema, found = "rep long, heads array<long>, low binary", []
    for parts in (1, 4, 37):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        edges = lsh_forest.forest_edges(spark.createDataFrame(rows, schema), params).collect()
        found.append({(min(e), max(e)) for e in edges})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    keys = sorted((t, h[t], bytes(low[t + 1 : t + 1 + lsh_forest.LEVELS]), i) for i, h, low in rows for t in (0, 1))
    brute = set()
    for k in (1, 2):
        for x, y in zip(keys, keys[k:]):
            if x[:2] == y[:2] and sum(a == b for a, b in zip(x[2], y[2])) >= params.agree:
                brute.add((min(x[3], y[3]), max(x[3], y[3])))
    assert found[0] == brute and all(brute <= f and len(f) < 1.05 * len(brute) for f in found[1:])


def test_a_cluster_of_thousands(spark):
    """3,000 near copies of one text, and 1,500 texts that share its half and are linked with nothing but their twin."""
    rng = random.Random(11)
    word = lambda: f"w{rng.getrandbits(40)}"
    base = [word() for _ in range(60)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(60)] = word()
        rows.append((i, " ".join(words)))
    for i in range(3000, 4500, 2):
        words = base[:35] + [word() for _ in range(25)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[:-1], word()]))]
    rng.shuffle(rows)
    params = lsh_forest.ForestParams(block=64, agree=1)
    found = {r.doc_id: r.component_id for r in rows_of(lsh_forest.near_components(spark.createDataFrame(rows, "doc_id long, text string"), params))}
    assert found == {i: 0 if i < 3000 else i - i % 2 for i in range(4500)}


def test_rows_without_id_or_words_stay(spark):
    df = table(spark, [(None, "some words of a text"), (5, "some words of a text"), (7, ""), (6, None), (7, "")])
    found = sorted((str(r.doc_id), r.component_id, r.kept) for r in rows_of(lsh_forest.near_components(df)))
    assert found == [("5", 5, True), ("6", 6, True), ("7", 7, True), ("7", 7, True), ("None", None, True)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1, i) for i in range(10, 60)] + [(300, 300), (None, 4), (7, 8), (8, 7), (7, 8)]
    found = {r.node: r.root for r in rows_of(components.components(spark.createDataFrame(edges, "a long, b long")))}
    expected = {i: 100 for i in range(100, 181)} | {i: 1 for i in [1, *range(10, 60)]} | {7: 7, 8: 7}
    assert found == expected


# Exact duplicates


def test_exact_groups_against_a_dictionary(spark, sf):
    docs = documents(spark, sf)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lower(r.text)].append(r.doc_id)
    found = {r.doc_id: r for r in rows_of(digest_index.op8_exact_dedup(docs))}
    for text, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())


def test_index_persists_and_grows(spark):
    path = new_path(spark, "index-test")
    first = table(spark, [(1, "A b"), (2, "a B"), (3, "c"), (4, None)])
    second = table(spark, [(5, "a b"), (6, "d"), (7, "D"), (8, "")])
    digest_index.deduplicate(first, digest_index.DigestIndex(spark, path, 4)).collect()
    index = digest_index.DigestIndex(spark, path, 4)
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows_of(digest_index.deduplicate(second, index))}
    assert found == {5: (2, 1, False), 6: (7, 2, False), 7: (7, 2, True), 8: (4, 1, False)}
    assert sorted(r.keep_id for r in rows_of(digest_index.DigestIndex(spark, path, 4).read())) == [2, 3, 4, 7]
    plan = index.unseen(index.read())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("job", [digest_index.op8_exact_dedup, digest_index.drop_copies])
def test_jobs_anti_join_with_the_index(spark, monkeypatch, job):
    asked, unseen = [], digest_index.DigestIndex.unseen

    def watched(index, groups, attempt):
        fresh = unseen(index, groups, attempt)
        asked.append((fresh._jdf.queryExecution().executedPlan().toString(), groups.count(), fresh.count()))
        return fresh

    monkeypatch.setattr(digest_index.DigestIndex, "unseen", watched)
    found = rows_of(job(table(spark, [(1, "a"), (2, "b"), (3, "A"), (4, "c"), (-5, "B"), (None, "c"), (None, "d")])))
    plan, rows, fresh = asked[-1]
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and (rows, fresh) == (3, 1)
    ids = sorted(str(r.doc_id) for r in found if job is digest_index.drop_copies or r.kept)
    assert ids == ["2", "3", "4", "None"]
    if job is digest_index.op8_exact_dedup:
        assert {r.text_sha256: (r.keep_id, r.group_size) for r in found} == {hashlib.sha256(t).hexdigest(): v for t, v in ((b"a", (3, 2)), (b"b", (2, 2)), (b"c", (4, 2)), (b"d", (None, 1)))}


def test_a_run_can_fail_and_be_repeated(spark, monkeypatch):
    """Digests of an attempt that was not committed count for nothing; a committed run is not done again."""
    path = new_path(spark, "index-test")
    first, second = table(spark, [(1, "a"), (2, "b")]), table(spark, [(3, "b"), (4, "c"), (5, "c")])
    say = lambda df: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows_of(df)}
    with digest_index.DigestIndex(spark, path, 4) as index:
        digest_index.deduplicate(first, index, "first")

    def lost(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as broken, pytest.raises(OSError), digest_index.DigestIndex(spark, path, 4) as index:
        broken.setattr(digest_index, "join_groups", lost)
        digest_index.deduplicate(second, index, "second")
    expected = {3: (2, 1, False), 4: (5, 2, False), 5: (5, 2, True)}
    before = len(spark.catalog.listTables())
    for _ in range(2):
        with digest_index.DigestIndex(spark, path, 4) as index:
            assert say(digest_index.deduplicate(second, index, "second")) == expected
    with digest_index.DigestIndex(spark, path, 4) as index:
        assert sorted((r.keep_id) for r in rows_of(index.read())) == [1, 2, 5]
        assert say(digest_index.deduplicate(first, index, "first")) == {1: (1, 1, True), 2: (2, 1, True)}
        assert say(digest_index.deduplicate(first, index)) == {1: (1, 1, False), 2: (2, 1, False)}
    assert len(spark.catalog.listTables()) == before


def test_dropping_copies_leaves_one_of_each(spark):
    unique = table(spark, [(1, "A b"), (2, "a B"), (3, "c"), (4, None), (5, "")])
    assert sorted(r.doc_id for r in rows_of(digest_index.drop_copies(clashing(unique)))) == [2, 3, 5]
    repeated = table(spark, [(1, "A b"), (1, "a B"), (1, "c"), (None, "c"), (None, "d"), (None, "d")])
    assert sorted((str(r.doc_id), lower(r.text)) for r in rows_of(digest_index.drop_copies(repeated))) == [("1", "a b"), ("1", "c"), ("None", "d")]


# Token files


def test_words_in_turn_equal_whole_texts():
    source = token_store.public_tokenizer()
    rng = random.Random(4)
    parts = ["a", "B", "'", "s", "'ll", " ", "\n", "1", "!", "É", "漢", "\x1c", "\x85", "　", "é", "́", "\x00", "Σ", "<|endoftext|>", "\xa0", "İ", "ﬁ", "\r"]
    for own in (token_store.WordEncoder(source), token_store.WordEncoder(source, keep=6)):
        for _ in range(1500):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
            assert np.frombuffer(own.encode(text.encode()), own.kind).tolist() == own._ids(text)


def test_token_files_hold_all_documents_in_order(spark, sf):
    docs = documents(spark, sf)
    own = token_store.WordEncoder(token_store.public_tokenizer())
    uri, start = new_path(spark, "store-test"), 0
    params = token_store.StoreParams(file_bytes=50_000)
    manifest = token_store.write_store(docs, token_store.public_tokenizer(), uri, params).collect()
    assert len(manifest) >= 4 and sum(m.documents for m in manifest) == docs.count()
    found = sorted(rows_of(token_store.read_store(spark, uri)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r, doc_id in zip(found, sorted(texts), strict=True):
        ids = [*own._ids(texts[doc_id]), 1]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    fs, folder = token_store.open_store(uri)
    dictionary = fs.open_input_stream(f"{folder}/dictionary.zdict").read()
    file = token_store.TokenFile(uri, sorted(m.file for m in manifest)[0], dictionary)
    doc_id = file.index[3][0]
    assert file.find(doc_id).tolist() == [*own._ids(texts[doc_id]), 1] and file.find(10**9) is None
    with pytest.raises(ValueError):
        token_store.TokenFile(uri, manifest[0].file, b"other")


@pytest.mark.parametrize("texts", [[], [None, ""], ["a"], ["same words"] * 300, [f"n{k}" for k in range(20)]])
def test_every_store_has_a_dictionary(spark, texts):
    """Also where there is nothing to train on; each frame still names and needs it."""
    rows = table(spark, [(None if k % 3 == 0 else k, t) for k, t in enumerate(texts)])
    uri, own = new_path(spark, "store-test"), token_store.WordEncoder(token_store.public_tokenizer())
    files = token_store.write_store(rows, token_store.public_tokenizer(), uri).collect()
    fs, folder = token_store.open_store(uri)
    dictionary = fs.open_input_stream(f"{folder}/dictionary.zdict").read()
    assert 0 < len(dictionary) <= token_store.StoreParams().dictionary_bytes
    found = rows_of(token_store.read_store(spark, uri))
    crc = lambda t: zlib.crc32(np.array([*own._ids(t or ""), 1], dtype="<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == Counter((None if k % 3 == 0 else k, crc(t)) for k, t in enumerate(texts))
    held = [i for m in files for i, *_ in token_store.TokenFile(uri, m.file, dictionary).index]
    assert sorted(held) == sorted(token_store.NO_ID if k % 3 == 0 else k for k in range(len(texts)))


# Mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing the excess anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def test_targets_against_repeated_sharing(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 40):
        sizes = {(f"s{k}" if k else None): int(rng.paretovariate(0.7) * 10) for k in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in rows_of(mixing.source_targets(df))}
        expected = fill(sizes)
        assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in found)


def test_mix_takes_near_targets_and_repeats(spark, sf):
    docs = documents(spark, sf)
    found = rows_of(mixing.op10_systematic_mix(docs))
    assert sorted(map(str, found)) == sorted(map(str, rows_of(mixing.op10_systematic_mix(docs.repartition(7)))))
    info = {r.doc_id: (r.source, len(WORDS.findall(r.text))) for r in docs.collect()}
    by_source = defaultdict(list)
    for r in found:
        assert r.size == info[r.doc_id][1] and r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        by_source[info[r.doc_id][0]].append(r)
    for own in by_source.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


def test_mix_rows_are_the_copies(spark, sf):
    docs = documents(spark, sf)
    copies = {r.doc_id: r.copies for r in rows_of(mixing.op10_systematic_mix(docs))}
    mixed = mixing.mix_rows(clashing(docs))
    assert mixed.columns == clashing(docs).columns
    assert Counter(r.doc_id for r in mixed.collect()) == {i: c for i, c in copies.items() if c}


# Pipeline


def test_pipeline_stages_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline

    docs = documents(spark, sf).union(table(spark, [(9001, "!!!", "en", "src1"), (9002, None, "en", "src1")]))
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert kept[-1].columns == columns
    before, said, exact, near, mixed, last = (df.collect() for df in kept)
    ids = lambda rows: sorted(r.doc_id for r in rows)
    assert ids(said) == [i for i in ids(before) if i < 9001]
    largest = {}
    for r in said:
        largest[lower(r.text)] = max(r.doc_id, largest.get(lower(r.text), -1))
    assert ids(exact) == sorted(largest.values())
    expected = brute_components(sorted((r.doc_id, r.text) for r in exact), 5)
    assert ids(near) == sorted(i for i, (_, c) in expected.items() if i == c)
    copies = {r.doc_id: r.copies for r in mixing.op10_systematic_mix(kept[3]).collect()}
    assert Counter(ids(mixed)) == {i: c for i, c in copies.items() if c}
    texts = {r.doc_id: r.text for r in mixed}
    base = bpe_tree.TreeCoder(bpe_tree.public_vocabulary()).base
    assert ids(last) == ids(mixed)
    assert all(r.n_tokens == len(base.encode_ordinary(texts[r.doc_id])) for r in last)
