"""Every operator against a plain version of itself, on odd cases and on the whole small table."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import exact_dedup, licenses, mixing, packing, quality, secret_scan, simhash, token_count, token_files, toxicity
from seqloom.llm.wordcache import WordEncoder

WHITE = " \t\n\v\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(found, wanted):
    assert Counter(map(tuple, found)) == Counter(map(tuple, wanted))


@pytest.fixture(params=["docs", "sample", "no_docs"])
def table(request):
    return request.getfixturevalue(request.param)


# 1 secrets

KINDS = {
    "assign": (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def base_spans(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [(kind, said) for _, k, said in sorted(found) for kind in [list(KINDS)[k]]]


def test_secrets(table):
    wanted = []
    for doc_id, text in rows_of(table):
        spans = base_spans(text)
        n = Counter(k for k, _ in spans)
        wanted.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(s for _, s in spans).encode()).hexdigest()))
    found = secret_scan.scan(table).collect()
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found], wanted)
    for r in found:
        own = [s for s in r["spans"].split(",") if s and s.split(":")[0] in KINDS]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r["base_sha256"]


def test_secrets_more_kinds(spark):
    text = "é ghp_" + "Z9" * 20 + " x -----BEGIN RSA PRIVATE KEY----- https://u:pw@host"
    r = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [s.split(":")[0] for s in r["spans"].split(",")] == ["forge", "pem", "url_login"]
    for s in r["spans"].split(","):
        kind, a, b = s.split(":")
        assert re.fullmatch({x.kind: x.pattern for x in secret_scan.MORE}[kind], text[int(a) : int(b)])


def strings_of(rnd, pattern):
    """A random string that the pattern matches, by its parsed form in Python's own parser."""
    import re._parser as parser

    def one(item):
        op, arg = str(item[0]), item[1]
        if op == "LITERAL":
            return chr(arg)
        if op == "NOT_LITERAL":
            return rnd.choice([c for c in "aZ9é" if ord(c) != arg])
        if op == "IN":
            accepted = [c for c in map(chr, [*range(9, 14), *range(32, 127), 233]) if re.fullmatch(pattern_of_class(arg), c)]
            return rnd.choice(accepted)
        if op == "BRANCH":
            return many(rnd.choice(arg[1]))
        if op == "SUBPATTERN":
            return many(arg[-1])
        if op == "MAX_REPEAT":
            return "".join(many(arg[2]) for _ in range(rnd.randint(arg[0], min(int(arg[1]), arg[0] + 3))))
        raise AssertionError(op)

    def pattern_of_class(items):
        spelt = ["^" if str(o) == "NEGATE" else f"\\x{a[0]:02x}-\\x{a[1]:02x}" if str(o) == "RANGE" else f"\\x{a:02x}" for o, a in items]
        return "[" + "".join(spelt) + "]"

    def many(items):
        return "".join(map(one, items))

    return many(parser.parse(pattern))


EXTRA_PATTERNS = ["abc", "a?bcd+e", "(ab|cde)f*ghi", "(?:x|y|z)(?:longer|words)[0-9]{2,3}end", "[abc]{3}d", "(?:abc)*", "a[^b]cde", "no|yes", "(?:one|two)?three", "ab{2}c\\.d"]


@pytest.mark.parametrize("pattern", [r.pattern for r in (*secret_scan.BASE, *secret_scan.MORE)] + EXTRA_PATTERNS)
def test_matches_satisfy_their_query(pattern):
    from seqloom.llm import trigram

    rnd, query, held = random.Random(pattern), trigram.query_of(pattern), trigram.held_by(pattern)
    for _ in range(400):
        said = strings_of(rnd, pattern)
        assert re.fullmatch(pattern, said)
        low = trigram.lower("x" * rnd.randint(0, 2) + said + "é")
        assert any(all(g in low for g in alt) for alt in query) and any(h in low for h in held)


def test_queries_are_derived():
    asked = {r.kind: r.query() for r in (*secret_scan.BASE, *secret_scan.MORE)}
    assert frozenset(["tok", "oke", "ken"]) in asked["assign"] and len(asked["assign"]) == 6
    assert asked["access"] == [frozenset(["aki", "kia"])] and asked["url_login"] == [frozenset(["://"])]
    assert [k for k, q in asked.items() if not q] == ["hex"]


def test_intersected_postings(spark):
    """A document is a candidate if one alternative's grams are all there, spread over the text or not."""
    rule = secret_scan.Rule("r", "abcd|xyz[0-9]+uvw", ".")
    texts = {1: "ABC ... bcd", 2: "abc", 3: "xyz uvw", 4: "xyz", 5: None, 6: "bcdabc xyz"}
    table = spark.createDataFrame([(k, t) for k, t in texts.items()] * 2, "doc_id bigint, text string")
    found = secret_scan.candidates(secret_scan.build_index(table, (rule,)), (rule,)).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 3, 6] and {r["hits"] for r in found} == {1}


def test_many_matches(spark):
    """Places in a text with more matches than blocks of blocks hold."""
    text = "".join(f"{'é' * (k % 3)}0123456789abcdef{k % 7 * ' '}G" for k in range(9000))
    r = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert r["spans"] == ",".join(said for _, said in base_spans(text)) and r["n_hex"] == 9000


def test_a_document_of_very_many_rows(spark):
    """Half of the rows alike, with a secret in them: they get their spans, and don't meet in one task."""
    said = "password = 'abcdefghijkl+/12' and AKIAABCDEFGHIJ1234"
    rows = spark.range(6000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS doc_id", f"""CASE WHEN id % 2 = 0 THEN "{said}" WHEN id % 5 = 0 THEN concat("token = abcdefghijklmnop", id) ELSE concat('plain ', id) END AS text""").repartition(4)
    got = secret_scan.scan(rows)
    counts = Counter((r["doc_id"] == 7 and r["n_access"] == 1, r["n_assign"], r["spans"][:14]) for r in got.collect())
    assert counts[True, 1, "assign:0:28,ac"] == 3000 and sum(n for (_, a, _), n in counts.items() if a) == 3600 and sum(counts.values()) == 6000
    assert got._jdf.queryExecution().toString().count("left_anti") == 0 and got._jdf.queryExecution().toString().count("LeftAnti") >= 2


def test_many_rules(docs):
    """More rules than a number has bits."""
    many = tuple(secret_scan.Rule(f"word{k}", f"word{k:03d}x", ".") for k in range(90))
    found = secret_scan.scan(docs.limit(1).withColumn("text", F.lit("word000x then word077x and word089x")), many[:2], many[2:]).first()
    assert found["spans"] == "word0:0:8,word77:14:22,word89:27:35" and (found["n_word0"], found["n_word1"]) == (1, 0)


# 2 SimHash


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(table):
    rows = [(d, plain_fingerprint(t)) for d, t in rows_of(table)]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.components(table).collect()], [(d, f"{f:016x}", least.get(find(f))) for d, f in rows])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 9])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(1, 200):
        fps[k] = fps[rng.integers(0, k)] ^ np.uint64(1 << int(rng.integers(0, 64)))
    fps = np.unique(fps)
    planes = simhash.planes_of(fps)
    bits = lambda found: np.unpackbits(np.ascontiguousarray(found).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    got = bits(simhash.near(planes, fps, radius)[0])
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps])
    assert (got.astype(bool) == want).all()
    later = simhash.lanes_up_to(0, len(fps), planes.shape[1], len(fps))
    found, abandoned = simhash.near(planes, fps, radius, later, simhash.differing(fps))
    assert (bits(found).astype(bool) == np.triu(want, 1)).all()
    # blocks behind the query are closed from the start, so those abandoned lie ahead of it; most have no near lane
    blocks = np.add.reduceat(np.triu(want, 1), np.arange(0, len(fps), 64), axis=1)
    assert 0 < abandoned <= (blocks == 0).sum()

    def classes(edges):
        root = {int(x): int(x) for x in fps.view(np.int64)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(int(a))] = find(int(b))
        return Counter(frozenset(y for y in root if find(y) == find(x)) for x in root)

    s = fps.view(np.int64)
    all_links = [(s[i], s[j]) for i, j in zip(*np.nonzero(want), strict=True) if i < j]
    assert classes(simhash.forest(fps, radius)) == classes(all_links)
    assert classes(simhash.small_forests(fps, np.array([0, len(fps)]), radius)) == classes(all_links)


def test_simhash_hub_and_chunks(spark, monkeypatch):
    """A ball of fingerprints and a long chain, in buckets that must be cut."""
    monkeypatch.setattr(simhash, "LANES", 16)
    centre = 0x123456789ABCDEF
    fps = {centre ^ (1 << b) for b in range(40)} | {centre}
    chain = 0x7777000011112222
    for b in range(30):
        chain ^= 1 << b
        fps.add(chain)
    nodes = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in fps], "fp bigint")
    star = {r["fp"]: r["root"] for r in simhash.stars(simhash.links(nodes)).collect()}
    roots = Counter(star.get(f, f) for f in [r["fp"] for r in nodes.collect()])
    assert sorted(roots.values()) == [30, 41]


# 3 mixing


def plain_targets(by_source, epochs=1.5, cap=2):
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, out, free = epochs * sum(by_source.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * by_source[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: cap * by_source[s] for s in over}
        free -= over
    return out


def test_mixing(table):
    rows = mixing.plan(table).collect()
    by_source = defaultdict(int)
    for r in table.select("text", "source").collect():
        by_source[r["source"]] += len(words(r["text"]))
    want = plain_targets(by_source)
    same([(r["doc_id"], r["size"]) for r in rows], [(d, len(words(t))) for d, t in rows_of(table)])
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == by_source[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 128, (s, taken[s], t)
    again = mixing.plan(table.repartition(2)).collect()
    same([(r["doc_id"], r["tie"], r["taken"]) for r in rows], [(r["doc_id"], r["tie"], r["taken"]) for r in again])


def test_mixed_texts(table):
    out = mixing.mixed(table)
    assert out.columns == table.columns
    got, want = defaultdict(int), defaultdict(int)
    for r in out.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(words(r["text"]))
    for r in mixing.plan(table).collect():
        if r["taken"]:
            want[r["doc_id"]] += r["taken"]
    assert got == want


def test_mixed_rows_keep_their_columns(spark):
    """Equal ids and texts under other sources, and true repeats: each row's own words and columns."""
    rnd = random.Random(9)
    text = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randint(1, 90))) for _ in range(6)]
    rows = [(1, text[0], "x", 1), (1, text[0], "y", 2), (1, text[1], "y", 3), (None, text[2], None, 4), (None, text[3], "x", 5)] + [(k, text[k % 6], "xyz"[k % 3], k) for k in range(10, 60)] * 2
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, `n.o` int").repartition(3)
    got, want = Counter(), Counter()
    for r in mixing.mixed(table).collect():
        assert any((r[0], r[2], r[3]) == (d, s, n) and set(r[1].split()) <= set(t.split()) for d, t, s, n in rows)
        got[r[0], r[2]] += len(words(r[1]))
    for r in mixing.plan(table).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert got == +want


# 4 token files, 9 counts, 10 packing


def encoded(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_files(table):
    rows = rows_of(table)
    ids = [x + [0] for x in encoded("byte_bpe_50k.json", [t for _, t in rows])]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).hexdigest()))
    want, start = [], 0
    for k in order:
        want.append((rows[k][0], start, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())))
        start += len(ids[k])
    same(token_files.round_trip(table, public_tokenizers.path("byte_bpe_50k.json")).collect(), want)


def test_token_file_reader(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    w = token_files.FrameWriter(out, wide=False)
    texts = [np.arange(k, dtype="<u4") for k in (0, 5, 1000)]
    for k, t in enumerate(texts):
        w.add(k * 10, t)
    w.close()
    raw = out.getvalue()
    r = token_files.FrameReader(io.BytesIO(raw), len(raw))
    assert r.doc_ids.tolist() == [0, 10, 20]
    for k, t in enumerate(texts):
        assert (r.tokens(k) == t).all()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain == b"".join(t.astype("<u2").tobytes() for t in texts)
    broken = bytearray(raw)
    broken[int(r.starts[2]) + 8] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(io.BytesIO(bytes(broken)), len(raw)).tokens(2)
    with pytest.raises(ValueError):
        token_files.FrameReader(io.BytesIO(raw[:-4]), len(raw) - 4)


@pytest.fixture
def many_partitions(spark):
    """Small tables keep the partitions of a shuffle."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_requested_documents(spark, many_partitions, docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write(docs, folder, vocabulary)
    assert len(files) > 1 and sum(x[2] for x in files) == docs.count()
    rows = [(d, t) for d, t in rows_of(docs) if d in (1, 7, 8, 105, 139)]
    want = [(d, np.array([*x, 0], "<u4").tobytes()) for (d, _), x in zip(rows, encoded("byte_bpe_50k.json", [t for _, t in rows]), strict=True)]
    asked = spark.createDataFrame([(k,) for k in (1, 7, 8, 105, 139, 5000, -3, None, 7)], "doc_id bigint")
    same([(r["doc_id"], bytes(r["ids"])) for r in token_files.requested(spark, folder, asked).collect()], want)
    assert token_files.write(no_docs, f"{folder}2", vocabulary) == [] and token_files.requested(spark, f"{folder}2", asked).count() == 0


def test_one_id_in_many_files(spark, many_partitions, tmp_path):
    """Rows of one id may fill several ranges; all are written once, in order, and found again."""
    table = spark.createDataFrame([(7, f"text number {k}") for k in range(400)] + [(k, "a") for k in range(14)], "doc_id bigint, text string")
    folder = f"file://{tmp_path}/tokens"
    files = token_files.write(table, folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(x[4] <= 7 <= x[5] for x in files) > 1
    assert token_files.requested(spark, folder, spark.createDataFrame([(7,)], "doc_id bigint")).count() == 401
    starts = [r["start"] for r in token_files.read(spark, folder, files).orderBy("start").collect()]
    assert len(starts) == len(set(starts)) == 414


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder(name, spaced):
    rnd = random.Random(3)
    parts = ["a", "b", "İ", "Σ", "é", "é", " ", " ", "\n", "\t", "\x1c", "\x00", " ", " ", "\u0085", "'s", "don't", ".", ",", "1", "23", "<|endoftext|>", "<|startoftext|>", "中", "́", "​", "!", "  ", "\r\n", "ſ", "A", "　"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    got = list(WordEncoder(public_tokenizers.path(name), spaced).encode_many(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == encoded(name, texts)


def test_counts(table):
    sp = token_count.model(public_tokenizers.path("piece_bpe_32k.model"))
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in rows_of(table)]
    same(token_count.counts(table, public_tokenizers.path("piece_bpe_32k.model")).collect(), want)


def test_safe_cuts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["ab", "c", " ", " ", "  ", "\n", "▁", "é", "<s>", "\t"]) for _ in range(rnd.randint(1, 200)))
        parts = token_count.chunks(text, 17)
        assert sum(len(token_count.model(path).encode(p)) for p in parts) == len(token_count.model(path).encode(text))


def check_pieces(rows, texts_by_id):
    want = Counter()
    for (doc_id, _), ids in zip(texts_by_id, encoded("word_bpe_49k.json", [t for _, t in texts_by_id]), strict=True):
        want[doc_id] += len(ids) + 1
    got, seqs = Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    lengths = []
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= 4096 and at & (at - 1) == 0
        lengths.append(at)
    return lengths


def test_packing(table):
    rows = packing.packed(table, public_tokenizers.path("word_bpe_49k.json")).collect()
    texts = rows_of(table)
    check_pieces(rows, texts)
    pieces = defaultdict(dict)
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].setdefault(r["start"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    times = Counter(d for d, _ in texts)
    for (d, _), ids in zip(texts, encoded("word_bpe_49k.json", [t for _, t in texts]), strict=True):
        if times[d] == 1:
            assert sum((pieces[d][s][0] for s in sorted(pieces[d])), []) == ids + [2]


def test_packing_cuts_little():
    rng = np.random.default_rng(1)
    items = [packing.Item(k, 0, np.zeros(int(n), "<u4"), int(n)) for k, n in enumerate(np.clip(rng.lognormal(6.5, 1, 4000), 1, 20000))]
    done, left = packing.pack(items)
    assert all(sum(len(x.ids) for x in s) == 4096 for s in done) and sum(len(x.ids) for x in left) < 4096
    total = sum(len(x.ids) for s in done for x in s) + sum(len(x.ids) for x in left)
    assert total == sum(len(x.ids) for x in items)
    cut = Counter(x.doc_id for s in done for x in s)
    short = [k for k, x in enumerate(items) if len(x.ids) < 4096]
    assert sum(cut[k] > 1 for k in short) < 0.15 * len(short)


def test_repeats_hold_to_the_stock():
    rng = np.random.default_rng(4)
    for _ in range(60):
        stock = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 17), 8, replace=False), rng.integers(0, 30, 8), strict=True)}
        used = Counter()
        for lengths, times in packing.repeat_counts(stock, 16, 3):
            assert sum(lengths) == 16 and len(lengths) <= 3 and times > 0
            used.update({k: n * times for k, n in Counter(lengths).items()})
        assert all(used[k] <= stock.get(k, 0) for k in used)
        can = any(all(stock.get(x, 0) >= n for x, n in Counter(c).items()) for c in [(16,), *((a, 16 - a) for a in range(1, 16)), *((a, b, 16 - a - b) for a in range(1, 15) for b in range(1, 16 - a))])
        assert bool(used) == can


def test_nnls():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, x = rng.random((12, 8)), np.maximum(rng.normal(size=8), 0)
        assert packing.nnls(a, a @ x) == pytest.approx(x, abs=1e-6)
        b = rng.normal(size=12)
        z = packing.nnls(a, b)
        g = a.T @ (b - a @ z)
        assert (z >= 0).all() and (g < 1e-5).all() and abs(g @ z) < 1e-5


# 5 toxicity


def test_toxicity_small(docs, no_docs, spark):
    labels = spark.createDataFrame([(100 + k, int(k % 2)) for k in range(40)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
    assert toxicity.scores(no_docs, model).count() == 0
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r["score"] for r in toxicity.scores(docs, None).collect()} == {0.0}
    out = toxicity.without_toxic(docs, model)
    assert out.columns == docs.columns and out.count() == sum(1 - r["predicted"] for r in got)


def test_word_hashes_are_of_words(monkeypatch):
    text = "Idiot, idiotic été 中文! x"
    (whole, units), *rest = toxicity.word_hashes(text)
    assert not rest and len(whole) == 5 and units.shape == (5, 4)
    again = next(toxicity.word_hashes("zz idiot"))
    assert again[0][1] == whole[0] and (again[1][1] == units[0]).all()
    assert units[0][1] == units[1][1] and units[0][0] != units[1][0]
    long = "word " * 300_000
    assert sum(len(w) for w, _ in toxicity.word_hashes(long)) == 300_000


def test_toxicity_held_out(spark):
    """Held-out accuracy on the small tables."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    wrong = sum(r["predicted"] == 1 and r["toxic"] == 0 for r in got)
    toxic = sum(r["toxic"] == 1 for r in got)
    assert hit >= 0.8 * toxic and wrong <= 0.02 * (len(got) - toxic), (hit, wrong, toxic, len(got))


def test_toxicity_learns_whole_texts(spark):
    """Texts of 5000 words of which one late word tells the toxic ones."""
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    rows = []
    for k in range(120):
        w = [rnd.choice(vocabulary) for _ in range(5000)]
        if k % 2:
            w[4500 + k] = "vermin"
        rows.append((k, " ".join(w)))
    table = spark.createDataFrame([*rows, (3, "a repeat of an id"), (5, None)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id bigint, toxic int")
    units, _, _ = toxicity.training_rows(table, labels)
    assert Counter(len(u) for u in units)[5000] >= len(units) - 2 and min(map(len, units)) <= 5
    model = toxicity.fit(table.filter("length(text) > 100"), labels)
    assert all((model.score(text) >= 0.5) == k % 2 for k, text in rows)


def test_score_is_a_plain_forward_pass(docs, spark):
    """Each text's score by loops: hashed units, sums of the filters' tables over spans, maxima, a logistic layer, the language's threshold."""
    labels = spark.createDataFrame([(100 + k, int(k % 2)) for k in range(40)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    names = sorted(toxicity.FUNCTION_WORDS)

    def plain(text):
        found = [m.encode() for m in re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", (text or "").lower())]
        units = []
        for w in found:
            raw = sum((c + 1) * pow(toxicity._ODD, k, 1 << 64) for k, c in enumerate(w)) % (1 << 64)
            first = [int.from_bytes(w[:k], "little") + k - 1 for k in (4, 5, 6)]
            units.append([(u * int(toxicity._MUL) % (1 << 64)) >> 47 for u in (raw, *first)])
        best = np.zeros(toxicity._N)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                for at in range(len(units) - width + 1):
                    total = sum(float(model.tables[sum(toxicity.WIDTHS[:k]) + j][u, f]) for j in range(width) for u in units[at + j])
                    best[k * toxicity.FILTERS + f] = max(best[k * toxicity.FILTERS + f], total + float(model.filter_bias[k * toxicity.FILTERS + f]))
        votes = [sum(w.decode() in toxicity.FUNCTION_WORDS[n].split() for w in found) for n in names]
        lang = max(range(len(names)), key=lambda k: (votes[k], -k))
        return 1 / (1 + np.exp(-(float(best @ model.out + model.bias) - model.middle[lang])))

    texts = {r["text"] for r in docs.collect()} | {"x", "one two", "Été 中文 the the", "under_score a-b", "\u0130stanbul"}
    for text in texts:
        if len(text or "") < 5000:
            assert model.score(text) == pytest.approx(plain(text), abs=1e-4)
    long = "the worst vermin " * 9000 + " ".join(f"w{k}" for k in range(90_000))
    parts = [x for _, x in toxicity.word_hashes(long)]
    assert sum(map(len, parts)) == 117_000 > toxicity.SLICE
    best = toxicity.pooled(model.tables, model.filter_bias, np.concatenate(parts))[0]
    assert model.logit(long)[0] == pytest.approx(float(best @ model.out + model.bias), abs=1e-4)


def test_maxima_of_texts_together():
    """Maxima over many texts at once, in slices, are those of each text alone."""
    rng = np.random.default_rng(3)
    emb, w = rng.normal(size=(50, toxicity.DIM)).astype(np.float32), rng.normal(size=(6, toxicity.DIM, toxicity.FILTERS)).astype(np.float32)
    bias = rng.normal(size=toxicity._N).astype(np.float32)
    units = [rng.integers(0, 50, (n, 4)) for n in (0, 1, 2, 3, 7, 0, 40, 1, 0)]
    best, where = toxicity.tops(emb, w, bias, np.concatenate(units), np.cumsum(list(map(len, units))))
    start = np.cumsum([0, *map(len, units)])
    tables = np.einsum("bd,sdf->sbf", emb, w)
    for k, u in enumerate(units):
        alone, at = toxicity.pooled(tables, bias, u)
        assert np.allclose(best[k], alone, atol=1e-4) and (where[k] == np.where(at >= 0, at + start[k], -1)).all()


def test_repeated_ids_stay_few(spark):
    """Rows that repeat a labelled id come down to one before the driver sees them."""
    table = spark.createDataFrame([(k, f"text {k}") for k in range(1, 35)], "doc_id bigint, text string")
    many = table.unionByName(table.filter("doc_id in (1, 2)").crossJoin(spark.range(3000)).select("doc_id", "text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 35)], "doc_id bigint, toxic int")
    units, _, got = toxicity.training_rows(many, labels)
    assert len(units) == len(got) == labels.filter(~toxicity.is_held_out(labels["doc_id"])).count()
    few, _, _ = toxicity.training_rows(many, labels, words=8)
    assert 0 < len(few) < len(units) and all(len(u) == 2 for u in few)


def test_toxicity_slices(monkeypatch):
    """Training by slices is training on whole texts."""
    rng = np.random.default_rng(13)
    labels = np.arange(40) % 2
    units = [rng.integers(2 * y, 400 + 2 * y, (int(rng.integers(0, 90)), 4)).astype("<i4") for y in labels]
    langs = np.zeros(40, np.int64)
    a = toxicity.train(units, langs, labels)
    monkeypatch.setattr(toxicity, "SLICE", 16)
    b = toxicity.train(units, langs, labels)
    assert np.allclose(a.tables, b.tables, atol=1e-4) and np.allclose(a.middle, b.middle, atol=1e-3)


# 6 licences

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(table):
    want = [(d, *plain_licenses(t)) for d, t in rows_of(table)]
    got = licenses.scan(table).collect()
    same([tuple(r)[:6] for r in got], want)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_licenses_random():
    rnd = random.Random(4)
    parts = ["cc", "BY", "General", "public", "license", "all", "rights", "reserved", "x", "é", "ccby"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "-", "\n", ". ", "", "  "]) for _ in range(rnd.randint(0, 14)))
        assert licenses.scan_text(text)[:5] == plain_licenses(text)


@pytest.mark.parametrize(
    ("said", "labels", "score"),
    [
        ("MIT", {"mit"}, 0.9),
        ("MIT OR GPL-2.0-only", {"mit", "gpl"}, 0.9),
        ("MIT AND GPL-2.0-only", {"mit", "gpl"}, 0.4),
        ("(MIT OR GPL-2.0) AND AGPL-3.0", {"mit", "gpl", "agpl"}, 0.3),
        ("MIT OR GPL-2.0 AND AGPL-3.0", {"mit", "gpl", "agpl"}, 0.9),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, 0.4),
        ("(MIT OR", {"mit"}, None),
        ("MIT OR (Apache-2.0", {"mit", "apache"}, None),
        ("(MIT OR Apache-2.0", {"mit", "apache"}, None),
        ("OR MIT", set(), None),
        ("(MIT Apache-2.0)", {"mit"}, None),
        ("(GPL-2.0 WITH Classpath-exception-2.0", {"gpl"}, None),
        ("MIT OR", {"mit"}, None),
        ("", set(), None),
    ],
)
def test_expressions(said, labels, score):
    assert licenses.evaluate(said) == (labels, score)
    if labels and score is not None:
        got = licenses.scan_text(f"// SPDX-License-Identifier: {said}\ncode")
        assert set(got[5].split(",")) == labels and got[6] == score


def plain_verdict(text):
    """Labels and score by the words alone and by recursive descent over the expressions."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, i + len(p.split()), label) for p, label in {**licenses.MORE, **licenses.BASE}.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels = {x for _, _, x in found}
    scores = [licenses.FREEDOM[x] for i, j, x in found if not any((a, b) != (i, j) and a <= i and j <= b for a, b, _ in found)]
    for at in re.finditer(r"(?i:spdx-license-identifier):?[ \t]*", text or ""):
        tokens = re.findall(r"[()]|[A-Za-z0-9.+:-]+", (text[at.end() :].split("\n\n") or [""])[0])
        pos, seen = 0, []

        def peek(tokens=tokens):
            return tokens[pos].lower() if pos < len(tokens) else None

        def side(names, inner):
            nonlocal pos
            out = inner()
            while peek() in names:
                name, pos = peek(), pos + 1
                other = inner()
                out = out if name == "with" else max(out, other) if name == "or" else min(out, other)
            return out

        def unit(tokens=tokens):
            nonlocal pos
            t = peek()
            if t is None or t in (")", "or", "and", "with"):
                raise ValueError
            pos += 1
            if t == "(":
                out = side({"or"}, lambda: side({"and"}, lambda: side({"with"}, unit)))
                if peek() != ")":
                    raise ValueError
                pos += 1
                return out
            if not (pos > 1 and tokens[pos - 2].lower() == "with"):
                seen.append(licenses.family(t))
            return licenses.FREEDOM.get(licenses.family(t), licenses.UNKNOWN)

        try:
            scores.append(side({"or"}, lambda: side({"and"}, lambda: side({"with"}, unit))))
        except ValueError:
            pass
        labels |= set(seen)
    return ",".join(sorted(labels)), min(scores, default=1.0)


def test_verdicts_random():
    rnd = random.Random(14)
    notices = [*licenses.MORE, *licenses.BASE, "gnu", "lesser", "plain words", "é"]
    for _ in range(600):
        text = " ".join(rnd.choice(notices).title() if rnd.random() < 0.5 else rnd.choice(notices) for _ in range(rnd.randint(0, 6)))
        if rnd.random() < 0.6:
            tokens = [rnd.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "LGPL-3.0", "Odd-1", "(", ")", "OR", "AND", "with", "CC-BY-4.0"]) for _ in range(rnd.randint(0, 7))]
            text += "\n# SPDX-License-Identifier: " + " ".join(tokens)
        assert licenses.scan_text(text)[5:] == plain_verdict(text), text


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("the GNU Lesser General Public License", "gpl,lgpl", 0.5),
        ("GNU Lesser General Public License and the General Public License", "gpl,lgpl", 0.4),
        ("cc by nc sa", "cc-by,cc-by-nc,cc-by-nc-sa", 0.2),
        ("# SPDX-License-Identifier: (MIT OR\n#   Apache-2.0) AND\n# ISC\nnot this BSD", "apache,isc,mit", 0.9),
        ("# SPDX-License-Identifier: (MIT OR", "mit", 1.0),
    ],
)
def test_verdicts(text, labels, score):
    assert licenses.scan_text(text)[5:] == (labels, score)


def test_long_expressions_take_linear_time():
    """Continuation lines, tags and open brackets, 100,000 each, and both at once."""
    tag, n = "SPDX-License-Identifier: ", 100_000
    texts = {
        "lines": (tag + "mit or\n" + "gpl-2.0 or\n" * n + "apache-2.0", {"mit", "gpl", "apache"}, 0.9), "tags": ((tag + "mit or\n") * n, {"mit"}, 1.0),
        "brackets": (tag + "(" * n + "mit", {"mit"}, 1.0), "closed": (tag + "(\n" * n + "mit" + "\n)" * n, {"mit"}, 0.9), "tags and lines": ((tag + "mit and\nbsd or\n") * n, {"mit", "bsd"}, 1.0),
    }
    for name, (text, labels, score) in texts.items():
        began = time.time()
        got = licenses.scan_text(text)
        assert (got[5], got[6]) == (",".join(sorted(labels)), score), name
        assert time.time() - began < 5, name


# 7 exact dedup


def test_exact(table):
    rows = [(d, t or "", "".join(c for c in t or "" if c not in WHITE)) for d, t in rows_of(table)]
    groups = defaultdict(list)
    for d, t, n in rows:
        groups[n].append((-len(t), d is None, d or 0, d))
    want = [(d, min(groups[n])[3], len(groups[n]), d == min(groups[n])[3], hashlib.sha256(n.encode()).hexdigest()) for d, t, n in rows]
    same(exact_dedup.resolve(table).collect(), want)
    left = exact_dedup.without_copies(table)
    assert left.columns == table.columns
    same([(r["doc_id"],) for r in left.collect()], [(min(g)[3],) for g in groups.values()])


def test_rows_kept_are_rows(spark):
    """Repeated ids with other texts, equal texts with other columns, null ids, true repeats, odd column names: rows, not ids."""
    schema = "doc_id bigint, text string, source string, `a.b` int, m map<string,int>"
    rows = [(1, "A x", "s", 1, {"k": 1}), (8, "A x", "s", 1, None), (8, "B", "s", 1, None), (9, "C", "t", 2, None), (9, "D", "t", 2, None), (1, "A x", "s", 1, {"k": 1}), (None, "E", "u", 3, None), (None, "Ax", "u", 3, None), (1, "A x", "s", 2, None)]
    found = exact_dedup.without_copies(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted(r["text"] for r in found) == ["A x", "B", "C", "D", "E"]
    by_text = {r["text"]: r for r in found}
    assert by_text["A x"]["doc_id"] == 1 and by_text["B"]["doc_id"] == 8 and all(tuple(r) in rows for r in map(lambda r: (*r[:4], r[4]), found))
    again = exact_dedup.without_copies(spark.createDataFrame(rows[::-1], schema).repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_repeated_rows_are_dealt_to_shards(spark):
    """Most rows alike in id, text and source: no shard takes more than its part of them, and all reruns agree."""
    rows = spark.range(24_000).selectExpr("CASE WHEN id % 6 > 0 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 6 > 0 THEN 'one two three' ELSE concat('words of ', id) END AS text", "'en' AS lang", "'s' AS source", "id % 3 AS n_chars")
    sized = mixing.numbered(mixing.sizes(rows))
    assert sized.count() == 24_000 and sized.filter("doc_id = 7 and tie = md5('one two three')").select("copy").distinct().count() == 20_000
    shards = F.pmod(mixing.seeded(0, F.lit("shard"), F.col("doc_id"), F.col("tie"), F.col("copy")), F.lit(24))
    assert sized.groupBy(shards.alias("shard")).count().agg(F.max("count")).first()[0] < 24_000 / 24 * 1.3
    runs = [Counter(map(tuple, mixing.plan(d).select("doc_id", "k", "size", "taken").collect())) for d in (rows, rows.repartition(5))]
    assert runs[0] == runs[1] and sum(runs[0].values()) == 24_000


def test_small_buckets_give_forests():
    """Links of many small buckets: fewer edges than fingerprints, and the same components."""
    rng = np.random.default_rng(4)
    tight = np.unique(np.array([0xABCDEF ^ (1 << b) for b in range(60)], np.uint64))  # any two differ in two bits
    loose = np.unique(rng.integers(0, 1 << 63, 30, dtype=np.uint64))
    fps, starts = np.concatenate([tight, loose]), np.array([0, len(tight), len(tight) + len(loose)])
    edges = simhash.small_forests(fps, starts, 2)
    assert len(edges) == 59 and len(np.unique(edges)) == 60
    assert len(simhash.small_forests(loose, np.array([0, len(loose)]), 2)) == 0


def test_index_persists(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    open_ = lambda: exact_dedup.DigestIndex.open(spark, f"file://{tmp_path}/index", 10)
    index = open_()
    first = frame([(1, "a b"), (2, "ab"), (3, "c")])
    assert {r["doc_id"] for r in exact_dedup.without_copies(first, index).collect()} == {1, 3}
    index.close()
    index = open_()  # as another session would
    assert index.part("first").count() == 2
    second = frame([(0, "a  b"), (4, "d"), (5, "d ")])
    assert {r["doc_id"] for r in exact_dedup.without_copies(second, index).collect()} == {5}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.resolve(frame([(6, "ab"), (7, "e")]), index).collect()}
    assert got == {6: (0, 4), 7: (7, 1)}
    groups = exact_dedup.grouped(exact_dedup.digests(second))
    for _ in range(2):  # a batch that is brought again changes nothing
        index.add(groups, "named")
    assert index.part("first").count() == 4 and index.part("again").filter("batch = 'named'").count() == 2
    index.close()


def test_small_batch_against_large_index(spark, tmp_path):
    """The index is never broadcast, whatever its groups hold; the anti-join is a sort-merge join."""
    index = exact_dedup.DigestIndex.open(spark, f"file://{tmp_path}/index", 10)
    old = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    exact_dedup.resolve(old.union(old), index).count()
    batch = spark.createDataFrame([(7, "text 7"), (5001, "new"), (5002, "text 8")], "doc_id bigint, text string")
    rows = exact_dedup.digests(batch)
    plan = rows.join(index.part("first").hint("merge").select("digest"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    found = exact_dedup.resolve(batch, index)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found.collect()} == {7: (7, 3), 5001: (5001, 1), 5002: (8, 3)}
    assert "digests_" not in found._jdf.queryExecution().toString()
    index.close()


def test_reruns_on_one_index(spark, tmp_path, monkeypatch):
    """The same rows again, and a run that failed between its two appends, give what one run gives."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    index = exact_dedup.DigestIndex.open(spark, f"file://{tmp_path}/index", 10)
    old, docs = frame([(10, "old"), (11, "ol d")]), frame([(1, "a b"), (2, "ab"), (3, "c"), (4, "o ld"), (5, "a b")])
    exact_dedup.resolve(old, index)
    append = exact_dedup.DigestIndex._append

    def failing(self, rows, name):
        if name == "first":
            raise RuntimeError("lost")
        append(self, rows, name)

    monkeypatch.setattr(exact_dedup.DigestIndex, "_append", failing)
    with pytest.raises(RuntimeError, match="lost"):
        exact_dedup.without_copies(docs, index)
    monkeypatch.setattr(exact_dedup.DigestIndex, "_append", append)
    for _ in range(3):
        assert {r["doc_id"] for r in exact_dedup.without_copies(docs.repartition(2), index).collect()} == {1, 3}
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.resolve(docs, index).collect()} == {1: (1, 3), 2: (1, 3), 3: (3, 1), 4: (4, 3), 5: (1, 3)}
    assert {r["group_size"] for r in exact_dedup.resolve(docs, index, name="on purpose").collect()} == {6, 2, 4}
    assert exact_dedup.without_copies(docs, index, name="once more").count() == 0  # another batch brought them
    # a better row of another batch doesn't take the place of this one's
    assert {r["doc_id"] for r in exact_dedup.without_copies(frame([(20, "new")]), index, name="x").collect()} == {20}
    exact_dedup.resolve(frame([(21, "n e w")]), index, name="y")
    assert {r["doc_id"] for r in exact_dedup.without_copies(frame([(20, "new")]), index, name="x").collect()} == {20}
    index.close()


def test_no_tables_stay_after_a_failure(spark, docs, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(exact_dedup.DigestIndex, "groups", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        exact_dedup.resolve(docs)
    monkeypatch.setattr(exact_dedup.DigestIndex, "add", lambda self, *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        exact_dedup.without_copies(docs)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_resolve_leaves_no_tables(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    a, b = exact_dedup.resolve(docs), exact_dedup.resolve(docs)
    same(a.collect(), b.collect())
    assert {t.name for t in spark.catalog.listTables()} == before


# 8 quality


def plain_stats(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality(table):
    got = quality.judge(table).collect()
    want = [(d, *plain_stats(t)) for d, t in rows_of(table)]
    same([tuple(r)[:6] for r in got], want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_repeats_random():
    rnd = random.Random(6)
    for _ in range(800):
        text = " ".join(rnd.choice("abc" if rnd.random() < 0.8 else "abcdefgh") for _ in range(rnd.randint(0, 60)))
        assert quality.stats(text)[4] == plain_stats(text)[4]


def test_outliers(spark):
    """A robust estimate rejects far rows, though they are a fifth of the group, and keeps the others."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4 + k % 4)) for k in range(400)]
    rows = []
    for k in range(300):
        w = list(rng.choice(vocabulary, int(rng.integers(60, 300))))
        rows.append((k, " ".join(x + "###$$" for x in w) if k % 5 == 0 else " ".join(w), "en", "a"))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[k] == (k % 5 != 0) for k in got)


def test_outliers_by_estimated_scatter(spark):
    """Junk of about a tenth symbols goes; a line said twice, a short text and one with many words stay."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4 + k % 4)) for k in range(400)]
    text = lambda n: "\n".join(" ".join(w) for w in np.array_split(rng.choice(vocabulary, n), max(1, n // 30)))
    rows, junk = [], set()
    for k in range(300):
        said = text(int(rng.integers(60, 300)))
        if k % 12 == 0:
            junk.add(k)
            said = " ".join(x + "#$"[j % 2] * (j % 5 < 3) for j, x in enumerate(said.split()))
        elif k % 12 == 1:
            said += "\n" + said.split("\n")[-1][:12]
        rows.append((k, said, "en", "a"))
    same_lines = "\n".join(["one line here", "one line here", *text(150).split("\n")])
    rows += [(300, text(15), "en", "a"), (301, same_lines, "en", "a"), (302, text(500), "en", "a")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert all(0.05 < r["n_symbols"] / r["n_words"] / 6.5 < 0.15 for r in got if r["doc_id"] in junk)
    assert {r["doc_id"] for r in got if not r["kept"]} == junk


def plain_mcd(x, h, rng, tries=60):
    """The least log determinant of the nearest h share's covariance, by concentration steps from random starts, and its mean."""
    best = (np.inf, None)
    n = int(np.ceil(h * len(x)))
    for _ in range(tries):
        own = x[rng.choice(len(x), x.shape[1] + 2, replace=False)]
        was = np.inf
        while True:
            mean, cov = own.mean(axis=0), np.cov(own.T, bias=True) + 1e-9 * np.eye(x.shape[1])
            d = np.einsum("ri,ij,rj->r", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d)[:n]]
            now = np.linalg.slogdet(np.cov(own.T, bias=True))[1]
            if not now < was - 1e-6:
                break
            was = now
        best = min(best, (was, tuple(own.mean(axis=0))))
    return best


def test_least_determinant(spark):
    """Groups with a tenth to a fifth of far rows: the determinant is the least that many random starts find."""
    rng, rows, groups = np.random.default_rng(11), [], {}
    for g in range(3):
        a = rng.normal(size=(6, 6))
        x = rng.normal(size=(400, 6)) @ a + rng.normal(size=6)
        far = rng.choice(400, 40 + 20 * g, replace=False)
        x[far] = x[far] * 0.3 + 15 * rng.normal(size=6)
        groups[f"s{g}"] = x
        rows += [("en", f"s{g}", *map(float, r)) for r in x]
    table = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"x{i} double" for i in range(6)))
    scale = quality._scale(quality.H)
    for r in quality.raw_mcd(table).collect():
        least, mean = plain_mcd(groups[r["source"]], quality.H, rng)
        assert r["logdet"] == pytest.approx(least + 6 * np.log(scale), abs=0.12)
        assert [r[f"m{i}"] for i in range(6)] == pytest.approx(mean, abs=0.3)


def test_distance_and_kept(spark, sample):
    """From the groups' raw estimates on: drawing towards parents, the chi-square step, distances and verdicts, in numpy."""
    rows = quality.statistics(sample).select("doc_id", "lang", "source", *quality._STATS, quality.base_failed().alias("base_failed"), *quality.features()).collect()
    table = spark.createDataFrame(rows)
    pairs, p = quality._PAIRS, quality._P

    def cov_of(r):
        c = np.zeros((p, p))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}{j}"]
        return c

    est = {(r["lang"], r["source"]): (r["n"], np.array([r[f"m{i}"] for i in range(p)]), cov_of(r)) for r in quality.raw_mcd(table).collect()}

    def mixed(parts):
        n = sum(x[0] for x in parts)
        mean = sum(x[0] * x[1] for x in parts) / n
        return n, mean, sum(x[0] * (x[2] + np.outer(x[1], x[1])) for x in parts) / n - np.outer(mean, mean)

    def towards(own, parent):
        (n, m, c), (_, pm, pc), k = own, parent, quality.PRIOR
        return n, (n * m + k * pm) / (n + k), (n * c + k * pc + n * k / (n + k) * np.outer(m - pm, m - pm)) / (n + k)

    def drawn(est):
        langs = {lang: mixed([v for (x, _), v in est.items() if x == lang]) for lang, _ in est}
        root = mixed(list(langs.values()))
        langs = {k: towards(v, root) for k, v in langs.items()}
        return {k: towards(v, langs[k[0]]) for k, v in est.items()}

    def guarded(c):
        c = c.copy()
        for i in range(p):
            c[i, i] = max(c[i, i], 0) + max(quality.GUARD - c[i, i], 1e-9)
        return c

    def distance(r, e):
        words, chars, lines = max(r["n_words"], 1), max(r["word_chars"], 1), max(r["n_lines"], 1)
        noise = np.array([1 / words, 1 / chars, 0.25 / chars, 0.25 / lines, 2.5 / words, 0.25 / chars])
        c = guarded(e[2])
        d = (np.array([r[f"x{i}"] for i in range(p)]) - e[1]) / np.sqrt(1 + noise / np.diag(c))
        return max(d @ np.linalg.inv(c) @ d, 0)

    first, last = drawn(est), {}
    for key in est:
        near = [r for r in rows if (r["lang"], r["source"]) == key and distance(r, first[key]) <= quality.chi2_quantile(0.01, p)]
        x = np.array([[r[f"x{i}"] for i in range(p)] for r in near])
        last[key] = (len(near), x.mean(axis=0), np.cov(x.T, bias=True).reshape(p, p) * quality._scale(0.99)) if near else (0.0, first[key][1], guarded(first[key][2]))
    last = drawn(last)
    want = {r["doc_id"]: distance(r, last[r["lang"], r["source"]]) for r in rows}
    limit = quality.chi2_quantile(quality.TAIL, p)
    for r in quality.judge(sample).collect():
        assert r["distance"] == pytest.approx(want[r["doc_id"]], rel=1e-4, abs=1e-4)
        assert r["kept"] == (not r["base_failed"] and want[r["doc_id"]] <= limit)


def test_chi2():
    assert quality.chi2_quantile(0.05, 6) == pytest.approx(12.592, abs=0.05)
    assert quality.chi2_tail(12.592, 6) == pytest.approx(0.05, abs=1e-4)
    assert quality.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4)
