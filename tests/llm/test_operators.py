"""The corpus operators against brute force, round trips and held-out accuracy, with the awkward cases of each."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import common, decontaminate, language, mixing, nearest, pii, secrets, simhash, token_files, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
SMALL = "/root/testdata/sf0.001"


def docs(spark, texts, source="s", lang="en"):
    rows = [(k, t, lang, source, len(t or ""), "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, a clashing extra column."""
    rows = [(1, "a b c d e f", "en", "s", 11, "k"), (1, "a b c d e f", "en", "s", 11, "k"), (2, None, None, None, None, None), (None, "one two three", "en", "t", 13, "k"), (3, "", "en", "s", 0, "k"), (4, "word " * 60_000, "en", "s", 300_000, "k"), (5, "1" * 50_000 + " a.b" * 20_000 + " x@" + "y." * 20_000, "en", None, 1, "k"), (6, " \t\n ", "fr", "t", 4, "k")]
    return spark.createDataFrame(rows, DOCS.replace("extra", "key"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components_match_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


# --- near duplicates -------------------------------------------------------------------------


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups(spark):
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(random.choices(vocabulary, k=random.randrange(0, 200))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:10] + ["", None, "Ä A b", "ä a B", "x"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [slow_print(t) for t in texts]
    assert [int(got[k]["fingerprint"], 16) for k in range(len(texts))] == prints
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4) for p in prints]
    assert [got[k]["component_id"] for k in range(len(texts))] == label
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == set(label)


def test_rows_of_one_id_and_unlike_texts_all_stay(spark):
    rows = [(1, "one two three four five", "k"), (1, "other words in this text here", "k"), (1, "one two three four five", "j"), (2, "one two three four five", "k"), (None, "one two three four five", "k"), (None, "nobody else has said this", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    for similarity in (None, 0.8):
        got = simhash.keep_one(df, similarity)
        assert got.columns == df.columns and sorted((str(r["doc_id"]), r["text"][:5]) for r in got.collect()) == [("1", "one t"), ("1", "other"), ("None", "nobod")]


def test_crowded_blocks_link_what_pairs_would(spark):
    random.seed(3)
    centre = random.getrandbits(64)
    prints = {centre}
    for _ in range(150):
        p = random.choice(sorted(prints))
        for b in random.sample(range(64), random.randrange(1, 6)):
            p ^= 1 << b
        prints.add(p)
    prints |= {random.getrandbits(64) for _ in range(50)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    whole, crowded = (common.components(simhash.links(df, crowd=c)) for c in (10_000, 3))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in crowded.collect()}


@pytest.mark.parametrize("crowd", [64, 2])
def test_edited_copies_are_near_duplicates(spark, crowd):
    random.seed(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [random.choices(vocabulary, k=random.choice([60, 200, 700])) for _ in range(30)]
    for _ in range(90):
        t = list(random.choice(texts[:30]))
        for at in random.sample(range(len(t)), max(1, len(t) * random.choice([1, 1, 2, 3, 6]) // 100)):
            t[at] = "edited"
        texts.append(t)
    texts = [" ".join(t) for t in texts] + ["", None, "one", "one two"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    alike = [[j for j, y in enumerate(sets) if x == y or len(x & y) >= 0.8 * len(x | y)] for x in sets]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in near) for near in alike]
    assert {r["id"]: r["component"] for r in simhash.similar(docs(spark, texts), crowd=crowd).collect()} == dict(enumerate(label))
    if crowd == 64:
        assert {r["doc_id"] for r in simhash.keep_one(docs(spark, texts), 0.8).collect()} == set(label)
        assert len(set(label)) < 70 < len({r["component_id"] for r in simhash.near_duplicates(docs(spark, texts)).collect()})


@pytest.mark.parametrize("rounds", [0, 1])
def test_crowds_of_unlike_texts_lose_no_link(spark, rounds):
    random.seed(13)
    vocabulary = [f"w{k}" for k in range(2000)]
    passage = random.choices(vocabulary, k=80)
    texts = [passage + random.choices(vocabulary, k=random.choice([15, 30, 60])) for _ in range(50)]
    for _ in range(50):
        t = list(random.choice(texts))
        for at in random.sample(range(len(t)), random.choice([0, 1, 2, 4])):
            t[at] = "edited"
        texts.append(t + random.choices(vocabulary, k=random.choice([0, 0, 1, 3])))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in texts]
    alike = [[j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in near) for near in alike]
    got = simhash.similar(docs(spark, [" ".join(t) for t in texts]), crowd=2, rounds=rounds)
    assert {r["id"]: r["component"] for r in got.collect()} == dict(enumerate(label))


def test_wide_fingerprints_are_simhashes_and_tables_catch_near_pairs():
    rng = np.random.default_rng(18)
    found = rng.integers(0, 1 << 63, 700, np.uint64)
    salt, votes = np.random.default_rng(42).integers(0, 1 << 63, 64, np.uint64), np.zeros((64, 8), int)
    for x in found:
        for lane, s in enumerate(salt.tolist()):
            h = (int(x) ^ s) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ h >> 31) * 0x94D049BB133111EB % 2**64
            votes[lane] += list((h ^ h >> 32).to_bytes(8, "little"))
    # Even bytes of all words come first, then odd ones.
    want = np.concatenate([votes[:, 0::2].ravel(), votes[:, 1::2].ravel()]) * 2 > 255 * len(found)
    assert (np.unpackbits(simhash.wide_fingerprint(found).view(np.uint8), bitorder="little") == want).all()
    chosen, missed = simhash.plan(50_000), 0
    for shared, more in [(8, 1), (80, 10), (400, 50)] * 300:  # a Jaccard similarity of 0.8
        z = rng.integers(0, 1 << 63, shared + 2 * more, np.uint64)
        pair = np.array([simhash.wide_fingerprint(z[more:]), simhash.wide_fingerprint(z[: shared + more])])
        one, two = simhash.table_keys(pair, chosen)
        apart = sum((int(x) ^ int(y)).bit_count() for x, y in zip(*pair[:, : simhash.CARRIED].view(np.uint64), strict=True))
        missed += not (one == two).any() or apart > simhash.reach()
    assert missed <= 1


def test_pipelines_near_duplicates_come_through_fingerprints(spark, monkeypatch):
    import corpus_pipeline as C

    random.seed(19)
    texts = [random.choices([f"w{k}" for k in range(3000)], k=100) for _ in range(10)]
    df = docs(spark, [" ".join(t) for t in texts] + [" ".join([*t, "tail"]) for t in texts] + [" ".join(t) for t in texts[:5]])
    assert {r["doc_id"] for r in C.drop_near_duplicates(spark, df, SMALL).collect()} == set(range(10))
    monkeypatch.setattr(simhash, "reach", lambda similarity, bits=0: -1)
    assert {r["doc_id"] for r in C.drop_near_duplicates(spark, df, SMALL).collect()} == set(range(20))


def test_tables_of_near_duplicates_grow_with_the_texts_and_go_when_done(spark, monkeypatch):
    from pathlib import Path

    assert len(simhash.plan(47_257)) == len(simhash.plan(236_076)) < 40
    random.seed(20)
    text, written = [f"w{k}" for k in random.choices(range(3000), k=300)], []
    texts = [" ".join([*text[:k], "edited", *text[k + 1 :]]) for k in range(150)]
    save = simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, name: written.append((name, (out := save(df, name)).count())) or out)
    assert [r["doc_id"] for r in simhash.keep_one(docs(spark, texts), 0.8).collect()] == [0]
    assert len(written) > 5 and max(n for _, n in written) < 150 * 40  # pairs would be 11,175
    assert not list(Path(common.shared_folder(spark)).glob("similar-*"))


@pytest.mark.parametrize("paired", [1 << 15, 60])
def test_groups_under_a_key_are_those_of_all_pairs(paired):
    rng = np.random.default_rng(21)
    rows = np.zeros(300, simhash.ENTRY)
    for k in range(300):
        bits = rng.random(512) < (0.01 if k >= 40 else 0.5)
        rows["print"][k] = np.packbits(bits, bitorder="little").view(np.uint64) ^ (rows["print"][rng.integers(k - 40, k)] if k >= 40 else 0)
    rows["n"] = rng.choice([100, 110, 200], 300)
    label = want = np.arange(300)
    near = [(i, j) for i in range(300) for j in range(i) if np.bitwise_count(rows["print"][i] ^ rows["print"][j]).sum() <= 125 and min(rows["n"][[i, j]]) >= 0.8 * max(rows["n"][[i, j]])]
    for _ in label:
        for i, j in near:
            want = np.where(want == max(want[i], want[j]), min(want[i], want[j]), want)
        if all(want[i] == want[j] for i, j in near):
            break
    got = simhash.near_groups(rows, 0.8, 128, 125, paired)
    assert len(near) > 300 and all(got[i] == got[j] for i, j in near)
    assert paired == 60 or (got == want).all()


def test_groups_of_alike_sets_are_those_of_all_pairs():
    rng = np.random.default_rng(22)
    for _ in range(20):
        sets = [rng.choice(1000, rng.integers(1, 60), replace=False)]
        for _ in range(40):
            base = sets[rng.integers(len(sets))]
            sets.append(np.unique(np.append(base[rng.random(len(base)) < rng.choice([0.8, 0.95, 1])], rng.integers(0, 1000, rng.integers(1, 4)))))
        label = list(range(len(sets)))
        for _ in sets:
            label = [min(label[j] for j, y in enumerate(sets) if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9) for x in sets]
        assert simhash.alike_groups(sets, 0.8).tolist() == label


def test_few_marks_change_no_near_duplicates(spark, monkeypatch):
    random.seed(23)
    texts = [random.choices([f"w{k}" for k in range(3000)], k=100) for _ in range(20)]
    df = docs(spark, [" ".join(t) for t in texts] + [" ".join([*t, "tail"]) for t in texts[:8]])
    df = df.union(df.where("doc_id < 3"))
    monkeypatch.setattr(simhash, "MARKS", 4)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df, 0.8).collect()) == list(range(20))


@pytest.mark.parametrize("buckets", [1 << 20, 16])
def test_rarest_shingles_pair_all_that_are_alike(spark, monkeypatch, buckets):
    monkeypatch.setattr(simhash, "BUCKETS", buckets)
    rng = np.random.default_rng(17)
    common, sets = rng.integers(-(1 << 62), 1 << 62, 60), []
    for _ in range(60):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else np.append(common[: rng.integers(60)], rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 40)))
        kept = base[rng.random(len(base)) < 0.95]
        sets.append(np.unique(np.append(kept, rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 4)))))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(sets)], "fp long, set array<long>")
    roots = [k % 50 for k in range(len(sets))]
    members = spark.createDataFrame([(k, len(x), roots[k]) for k, x in enumerate(sets)], "fp long, n long, root long")
    got = {frozenset(r) for r in simhash.prefix_pairs(members, rows, 0.8).collect()}
    alike = {frozenset((i, j)) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if roots[i] != roots[j] and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))}
    assert len(alike) > 10 and alike <= got
    assert all(roots[i] != roots[j] for i, j in map(sorted, got))


# --- token files -----------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [7], [5] * 1000, list(range(300)), [0, 2**32 - 1] * 70])
def test_packing_round_trip(ids):
    assert token_files.unpack(token_files.pack(np.array(ids, np.uint32))).tolist() == ids
    rng = np.random.default_rng(1)
    mixed = np.where(rng.random(5000) < 0.05, rng.integers(0, 2**31, 5000), rng.integers(100, 900, 5000)).astype(np.uint32)
    packed = token_files.pack(mixed)
    assert (token_files.unpack(packed) == mixed).all() and len(packed) < 4 * 5000 * 0.6


def test_token_files_match_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.tokenizer_path("byte_bpe_50k.json"))
    random.seed(4)
    pieces = [*" \n\t.,ab", "é", "  ", " \n", "'s", "word.", "日本", " ", "\x1c"]
    texts = ["".join(random.choices(pieces, k=random.randrange(60))) for _ in range(300)] + [None, "", "A line.\nAnother, and more."]
    got = token_files.token_files(docs(spark, texts)).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, texts, strict=True):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        at += len(ids)


def test_encoder_looks_new_pieces_up_once():
    class Counting(dict):
        asked = 0

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

    encoder = token_files.Encoder(token_files.tokenizer_path("byte_bpe_50k.json"))
    for known in encoder.known:
        known.number = Counting()
    text = " ".join(f"word{k}x" for k in range(500))
    assert encoder.encode([text])[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert sum(known.number.asked for known in encoder.known) == 0


def test_encoder_forgets_and_relearns():
    encoder = token_files.Encoder(token_files.tokenizer_path("byte_bpe_50k.json"), most=9000)
    random.seed(5)
    pieces = [*" \n\t.,ab", "\0", "\n\n", "\x1c", "\r", "\u3000", "word.", "two", "😀"]
    texts = ["".join(random.choices(pieces, k=random.randrange(40))) for _ in range(600)] + ["", "\0", " ", ".", "The end."]
    for at in range(0, len(texts), 100):
        for t, ids in zip(texts[at : at + 100], encoder.encode(texts[at : at + 100]), strict=True):
            assert ids.tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2], repr(t)
    assert encoder.encode([]) == []


# --- mixing ----------------------------------------------------------------------------------


def test_targets_stop_at_twice_the_size():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 0], [1, 1]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_permutations_are_permutations():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 3))) == list(range(n))


def test_draws_take_every_slot():
    slots = [10_000, 0, 333, 5]
    rows = list(mixing.draw(slots, 512))
    for k, n in enumerate(slots):
        mine = sorted((first, count) for _, s, first, count in rows if s == k)
        assert sum(c for _, c in mine) == n and all(a + c == b for (a, c), (b, _) in itertools.pairwise(mine))


def test_mix_nears_its_targets_and_repeats(spark):
    random.seed(5)
    rows = [(k, " ".join(["w"] * random.randrange(0, 400)), "en", random.choice(["a", "b", "c", None]), 0, "x") for k in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    one, two = mixing.taken(df).collect(), mixing.taken(df).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 400
    per = {}
    for r in one:
        assert r["taken"] <= 2 * r["size"] == 2 * len(rows[r["doc_id"]][1].split())
        per.setdefault(rows[r["doc_id"]][3], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 0.02 * t + 64 for t, n in per.values())
    words = {}
    for r in mixing.mixed(df).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {r["doc_id"]: r["taken"] for r in one if r["taken"]}
    clash = df.withColumnsRenamed({"extra": "key", "lang": "spans"})
    assert mixing.mixed(clash).columns == clash.columns and mixing.mixed(clash).count() == mixing.mixed(df).count()


def test_small_sources_meet_their_targets_to_the_word(spark):
    n = np.full(100, 37)
    assert all((mixing.permute(mixing.permute(np.arange(37), n[:37], np.full(37, k)), n[:37], np.full(37, k), back=True) == np.arange(37)).all() for k in range(20))
    rows = [(k, " ".join(["w"] * size), "en", f"s{k:02}", 0, "x") for k, size in enumerate([10, 40, 1, 64, 65, 700, 3001, 129, 20, 333])]
    rows += [(100 + k, " ".join(["w"] * (k + 1)), "en", "t", 0, "x") for k in range(40)]
    per = {}
    for r in mixing.taken(spark.createDataFrame(rows, DOCS)).collect():
        source = "t" if r["doc_id"] >= 100 else r["doc_id"]
        per.setdefault(source, [r["target"], 0])[1] += r["taken"]
    assert all(abs(target - n) <= 1 for target, n in per.values()), per


# --- URLs ------------------------------------------------------------------------------------


def test_block_decisions_reach_aliases(spark):
    link = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    rows = [
        (1, "http://a.example.com/en/1", ""), (2, "http://b.test/x", link("http://a.example.com/en/1")), (3, "http://c.test/y#f", '<meta http-equiv="refresh" content="0; url=http://b.test/x">'),
        (4, "http://example.com/en/70", link("http://a.example.com/en/1")), (5, "http://d.test/", link("/rel")), (6, "http://d.test/rel", link("http://gone.org/es/")), (7, "nothing", link("http://a.example.com/en/1")),
        (8, None, None), (9, "http://EXAMPLE.net/de/81?q", ""), (10, "http://example.net/de/7", ""), (11, "http://free.test/", None), (11, "http://free.test/", None),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block") and got[2][3] == got[3][3] == "block"
    assert got[4][2:] == ("example.com/en/7", "allow") and got[5][3] == got[6][3] == "block"
    assert got[7] == got[8] == ("", "", None, "allow") and got[9] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[10][2:] == ("net/de/", "allow") and got[11][3] == "allow"
    one = urls.judged(spark.createDataFrame(rows[-1:], "page_id long, url string, html string"), redirects=spark.createDataFrame([("http://free.test/", "http://m.com/en/")], "source string, target string"))
    assert one.first()["verdict"] == "block"
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_aliases_meet_however_they_are_spelled(spark):
    assert urls.normal("HTTP://B.Test#f") == "http://b.test/" and urls.normal("http://b.test/a/./b/../../c/..?Q=../x") == "http://b.test/?Q=../x"
    page = "http://a.test/d/p?old=1"
    for link, want in {"../x": "http://a.test/x", "?a=1&amp;b=2": "http://a.test/d/p?a=1&b=2", "x/./y": "http://a.test/d/x/y", "//B.test/x": "http://b.test/x", "#f": page, "&#104;ttp://b.test/": "http://b.test/"}.items():
        assert urls.absolute(link, page) == want
    canonical = lambda u: f'<link rel="canonical" href="{u}">'
    refresh = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    rows = []
    for k, (link, url) in enumerate([("http://B.test/0", "http://b.test/0"), ("http://b.test/q?page=2&amp;ref=x", "HTTP://b.test/q?page=2&ref=x"), ("../../2", "http://a.test/2"), ("?3", "http://a.test/d/p3?3"), ("http://b.test", "http://b.test/")]):
        for way, tag in enumerate((canonical, refresh)):
            own = str(2 * k + way)
            spelled = lambda u: u.replace("b.test", f"b{own}.test").replace("B.test", f"B{own}.test").replace("a.test", f"a{own}.test")  # noqa: B023, E731
            rows += [(10 * k + 2 * way, spelled(f"http://a.test/d/p{k}"), tag(spelled(link))), (10 * k + 2 * way + 1, spelled(url), canonical("http://bad.com/en/1"))]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"}, got
    moved = spark.createDataFrame([("HTTP://Free.test/a/../b", "http://m.COM/en/")], "source string, target string")
    assert urls.judged(spark.createDataFrame([(1, "http://free.test/b", None)], "page_id long, url string, html string"), redirects=moved).first()["verdict"] == "block"


# --- toxicity and language -------------------------------------------------------------------


def test_kernel_matches_its_definition():
    def features(w):
        out = {}
        for a, b, c in itertools.combinations(range(len(w)), 3):
            if not {w[a], w[b], w[c]} & set(".-"):
                key = (w[a], w[b], w[c])
                out[key] = out.get(key, 0) + toxicity.DECAY ** (c - a + 1)
        return out

    words = ["idiot", "i.d.i.o.t", "banana", "ab", "nab", "a-b-a-b"]
    got = toxicity._kernel(words, words)
    for i, j in itertools.product(range(len(words)), repeat=2):
        x, y = features(words[i]), features(words[j])
        norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        assert got[i, j] == pytest.approx(sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0, abs=1e-4)


def sentences(seed, bad, n=260):
    random.seed(seed)
    parts = ["the", "er", "ing", "on", "an", "re", "ha", "th", "ti", "es"]
    out = []
    for k in range(n):
        words = ["".join(random.choices(parts, k=random.randrange(1, 4))) for _ in range(30)]
        if k % 2:
            words[random.randrange(30)] = bad()
        out.append((k % 2, " ".join(words)))
    return out


def test_toxicity_tolerates_gaps_and_leaves_clean_text():
    insults = ["moron", "stupid", "clown"]
    model = toxicity.train([(y, toxicity.units(t)) for y, t in sentences(6, lambda: random.choice(insults))])
    score = lambda t: model.probability(max(model.margins(sorted(toxicity.units(t))), default=-9))
    gapped = lambda: random.choice(["m.o.r.o.n", "stu-pid", "c l o w n", "CLOWN!", "mo.ron"])
    right = [(score(t) >= toxicity.THRESHOLD) == bool(y) for y, t in sentences(7, gapped, 200)]
    assert np.mean(right) >= 0.95


@pytest.mark.parametrize("script", ["абвгдежзик", "αβγδεζηθικ", "कखगघचछजझटठ", "가나다라마바사아자차"])
def test_toxicity_tells_words_of_equal_length_in_other_scripts(script):
    random.seed(13)
    word = lambda: "".join(random.choices(script, k=6))
    bad = [word() for _ in range(3)]
    clean = [w for w in (word() for _ in range(150)) if w not in bad]
    text = lambda y: " ".join([*random.choices(clean, k=20), *([random.choice(bad)] if y else [])])
    model = toxicity.train([(k % 2, toxicity.units(text(k % 2))) for k in range(200)])
    right = [(model.probability(model.margins(sorted(toxicity.units(text(y)))).max()) >= toxicity.THRESHOLD) == bool(y) for y in [0, 1] * 50]
    assert np.mean(right) >= 0.95


def test_toxicity_defined_for_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(awkward(spark), labels)
    assert got.count() == 8 and got.where("score is null or score < 0 or score > 1 or predicted is null or held_out is null").count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs(spark, ["x"]), none).first()["predicted"] == 0 and toxicity.not_toxic(empty(spark), none).count() == 0


def test_gradients_match_differences():
    net, rng = language.Network(3, hidden=3), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])
    x[4:, 1] = 256
    _, g = net.gradients(x, y)
    for name, p in net.p.items():
        used = [(i, j) for i in range(p.shape[0]) for j in (x[0, :2] if p.shape[1] == 257 else range(p.shape[1]))]
        for i, j in used[:6]:
            old = p[i, j]
            p[i, j] = old + 1e-3
            up, _ = net.gradients(x, y)
            p[i, j] = old - 1e-3
            down, _ = net.gradients(x, y)
            p[i, j] = old
            assert g[name][i, j] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3), name


def test_language_is_learned_and_every_position_labelled(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language.language(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.9
    odd = {r["doc_id"]: r for r in language.language(awkward(spark)).collect()}
    assert odd[2]["lang_pred"] == odd[3]["lang_pred"] == odd[6]["lang_pred"] == "und" and odd[4]["lang_pred"] != "und"
    assert language.language(empty(spark)).count() == 0
    net = language.Network(3)
    x = language._spans(b"some bytes" * 30).T.astype(np.int64)
    assert np.allclose(np.exp(net.positions(x)).sum(1), 1, atol=1e-4)
    assert np.allclose(net._read("f", x), net._run("f", x, False)[0], atol=1e-4)


# --- nearest neighbours ----------------------------------------------------------------------


def test_nearest_has_recall_ties_and_exact_scores(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.6 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:140] = x[100]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [], 0), (None, x[0].tolist(), 0)]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        score = d @ d[q]
        score[q] = -np.inf
        true = np.lexsort((np.arange(900), -np.round(score, 12)))[:20]
        hits += len(set(true) & {v for v, _ in found})
        assert len(found) == 20 and all(s == pytest.approx(score[v], abs=1e-12) for v, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        same = [v for v, _ in found if 100 <= v < 140]
        assert same == sorted(same)
    assert hits / (20 * len(got)) >= 0.9
    few = nearest.nearest(spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, -1.0], 0)], "vec_id long, embedding array<float>, label int")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 1.0)]
    odd = [(0, [1.0, 2.0], 0, "a"), (0, [1.0, 2.0], 0, "a"), (1, [3.0, -1.0], 0, None), (20, [1.0, 1.0, 1.0], 0, "b"), (21, [2.0, 0.0, 0.0], 0, "b"), (40, [5.0], 1, "c")]
    found = sorted(tuple(r) for r in nearest.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<float>, query_id long, rank string")).collect())
    assert found == [(0, 1, 1, 1.0), (0, 1, 1, 1.0), (20, 1, 21, 2.0)]
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_scores_of_few_pairs_match_the_product():
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(30, 8)), rng.normal(size=(50, 8))
    for share in (0.02, 0.5):
        seen = rng.random((30, 50)) < share
        assert np.allclose(np.where(seen, nearest._scores(q, x, seen), 0), np.where(seen, q @ x.T, 0)) and np.isneginf(nearest._scores(q, x, seen)[~seen]).all()


@pytest.mark.parametrize("length", [3.0, 40.0])
def test_one_long_vector_costs_no_recall(spark, monkeypatch, length):
    monkeypatch.setattr(nearest, "SAMPLE", 500)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[-1] *= length
    got = {}
    for r in nearest.nearest(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & got[q])
    assert hits / (20 * 200) >= 0.9


# --- secrets and personal data ---------------------------------------------------------------


def slow_spans(kinds, text):
    return sorted((m.start(), k, m.end(), n) for k, (n, p, keep) in enumerate(kinds) for m in re.finditer(p, text or "") if keep(m))


SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
]


@pytest.mark.parametrize(("find", "kinds", "pieces"), [
    (secrets.op1_secrets, SECRETS, ["token", "PassWord", "api_key", "apikey", "=", ": ", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef" * 2, " ", "é", "😀", "x", "secret:", "abcdefgh", "\n"]),
    (pii.op9_pii, PII, ["a@b.c", "a", "@", ".", "b-c", "+", "1", "4111 1111 1111 1111", "12", "-", " ", "1.2.3.4", "256", "001", "(", ")", "+49 30 1234567", "é", "😀", "%", "x@y.z+w@v.u"]),
])
def test_base_spans_match_the_patterns(spark, tmp_path, find, kinds, pieces):
    random.seed(9)
    texts = ["".join(random.choices(pieces, k=random.randrange(25))) for _ in range(600)] + [None, "", pieces[0] * 300]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in find(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        want = slow_spans(kinds, t)
        said = ",".join(f"{n}:{a}:{b}" for a, _, b, n in want)
        assert got[k]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), repr(t)
        assert [got[k][f"n_{n}"] for n, _, _ in kinds] == [sum(x[3] == n for x in want) for n, _, _ in kinds]
        assert set(filter(None, said.split(","))) <= set(got[k]["spans"].split(","))


def test_weak_parts_are_reported_together_only(spark):
    secret, name, place = "Zx9Kq2Lm8Pw4Rt6Yv1Bn3", "username = admin", "postgres://db.test:5432/x"
    texts = [f"{name} and {secret} at {place}", f"{name} {'.' * 400} {secret}", f"{place} {secret}", name, f"password={secret}", f"{secret} AKIA{'B' * 16}"]
    texts += [f"username={secret}", "login = https://Example.test/PathOf/Things/2024/File", "photo /Users/Alice/Docs2024/Thesis-final user: alice", f"https://h.test/{secret} user: alice"]
    got = {r["doc_id"]: [x["kind"] for x in r["extra"]] for r in secrets.secrets(docs(spark, texts)).collect()}
    assert got == {0: ["weak_access", "weak_secret", "weak_endpoint"], 1: [], 2: [], 3: [], 4: [], 5: ["weak_secret"], 6: [], 7: [], 8: [], 9: []}
    safe = {r["doc_id"]: r["text"] for r in secrets.redacted(docs(spark, texts)).collect()}
    assert secret not in safe[0] and secret in safe[1] and safe[4] == "<SECRET>"


def test_linked_parts_match_all_pairs(spark):
    random.seed(15)
    kinds = [k.name for k in [*secrets.BASE, *secrets.WEAK]]
    rows = []
    for key in range(150):
        for _ in range(random.randrange(1, 14)):
            place, start = random.randrange(6), random.randrange(120)
            rows.append((key, (start, place, start + random.randrange(1, 25), kinds[place])))
    rows = sorted(set(rows))
    got = {(r["key"], tuple(r["p"])) for r in secrets.linked(spark.createDataFrame(rows, "key long, p struct<start:bigint,place:int,end:bigint,kind:string>"), 20).collect()}
    want = set()
    for key in range(150):
        mine = [p for k, p in rows if k == key]
        over = lambda p, q: p[0] < q[2] and q[0] < p[2]
        free = [p for p in mine if p[1] < 3 or not any(over(p, q) for q in mine if q[1] < 3 or (p[1] == 4 and q[1] == 5))]
        for p in free:
            near = {q[3] for q in free if not over(p, q) and max(q[0] - p[2], p[0] - q[2]) <= 20}
            access, secret = near & set(secrets.ACCESS), near & set(secrets.SECRET)
            if {3: secret, 4: access, 5: access and secret}.get(p[1]):
                want.add((key, p))
    assert got == want and len(want) > 50


def test_a_text_of_very_many_matches_takes_seconds(spark):
    import time

    n, began = 10_000, time.time()
    text = "".join(f"user={k}abcd by ann{k}@corp.test {k}Zx9Kq2Lm8Pw4Rt6Yv1Bn3 " for k in range(n))
    assert len(secrets.secrets(docs(spark, [text])).first()["extra"]) == 2 * n
    assert secrets.redacted(docs(spark, [text])).first()["text"].count("<SECRET>") == 2 * n
    assert len(pii.personal(docs(spark, [text])).first()["base"]) == n and pii.sanitised(docs(spark, [text])).first()["text"].count("<EMAIL>") == n
    assert time.time() - began < 90  # with quadratic steps several hundred


def slow_disclosing(texts, support=3, threshold=pii.GENERALISE):
    """{(term, entity): (rows with both, rows with the term, rows with the entity, bits, disclosure)}"""
    word = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+", t)]
    seen, term_rows, entity_rows = {}, {}, {}
    for t in texts:
        spans, pairs = slow_spans(PII, t), set()
        for k, (a, _, b, _) in enumerate(spans):
            left = t[min(a, spans[k - 1][2]) if k else 0 : a]
            right = t[b : max(b, spans[k + 1][0]) if k + 1 < len(spans) else len(t)]
            pairs |= {(w, t[a:b]) for w in word(left)[-pii.NEAR :] + word(right)[: pii.NEAR]}
        for p in pairs:
            seen.setdefault(p, []).append(t)
        for w in set(word(t or "")):
            term_rows[w] = term_rows.get(w, 0) + 1
        for e in {t[a:b] for a, _, b, _ in spans}:
            entity_rows[e] = entity_rows.get(e, 0) + 1
    out = {}
    for (w, e), held in seen.items():
        information = np.log2(len(texts) / entity_rows[e])
        bits = np.log2(len(texts) * len(held) / (term_rows[w] * entity_rows[e]))
        if len(set(held)) >= support and information > 0 and bits / information >= threshold:
            out[w, e] = (len(held), term_rows[w], entity_rows[e], bits, bits / information)
    return out


def test_disclosure_matches_its_definition(spark):
    random.seed(16)
    people = [("ann@corp.test", "zanzibar"), ("10.0.0.1", "Quagga"), ("bob@x.test", "li")]
    vocabulary = [f"{a}{b}" for a in "klmnprst" for b in ("a", "e", "i", "o", "ou")]
    texts = []
    for _ in range(160):
        words = random.choices(vocabulary, k=random.randrange(1, 30))
        for entity, term in random.sample(people, random.choice([0, 0, 1, 2])):
            at = random.randrange(len(words) + 1)
            words[at:at] = [term, entity] if random.random() < 0.85 else [entity]
        texts.append(random.choice([" ", "  ", ", ", " " * 70]).join(words))
    texts += texts[:20] + ["about zanzibar alone", "x" * 5000 + " quagga"]
    df = docs(spark, texts)
    rows = df.select(F.xxhash64("text").alias("hash"), "text")
    base = pii.find(rows, "text", pii.BASE, "base")
    for threshold in (pii.GENERALISE, 0.3):
        got = pii.disclosing(base.select("hash", pii._contexts(F.col("text"), F.col("base")).alias("found")), rows, threshold=threshold)
        found = {(r["term"], r["entity"]): (r["together"], r["term_rows"], r["entity_rows"], pytest.approx(r["bits"]), pytest.approx(r["disclosure"])) for r in got.collect()}
        want = slow_disclosing(texts, threshold=threshold)
        assert found == want and want
    worst = {}
    for (w, _), x in slow_disclosing(texts).items():
        worst[w] = max(worst.get(w, 0), x[4])
    want = {k: [("term" if worst[m.group().lower()] >= pii.REMOVE else "hint", *m.span()) for m in re.finditer(r"[^\W\d_]+", t) if m.group().lower() in worst] for k, t in enumerate(texts)}
    for sent in (pii.SENT, 0):
        assert {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["extra"]] for r in pii.personal(df, sent=sent).collect()} == want
    assert {x[0] for v in want.values() for x in v} >= {"term"} and want[180]


def test_disclosing_terms_are_removed_or_generalised(spark):
    texts = [f"{a} {b} zanzibar ann@corp.test {c} {d}" for a, b, c, d in (("many", "some", "were", "here"), ("other", "thing", "seen", "there"), ("fresh", "water", "runs", "down"))]
    texts += ["nothing much", None] + [f"plain words {w} in rows" for w in ("many", "some", "fresh", "water", "other", "were")] + texts[:1] * 3
    safe = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, texts)).collect()}
    assert safe[0].startswith("many some  <EMAIL> were") and safe[4] is None and safe[5] == texts[5]
    more = [*texts, "the codename zanzibar alone"]
    safe = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, more)).collect()}
    assert safe[len(texts)] == "the codename <HINT> alone"


def test_replacing_keeps_columns_with_clashing_names(spark):
    rows = [(1, "mail a@b.c and password=abcdefgh1", "k", "s"), (1, "mail a@b.c and password=abcdefgh1", "k", "s"), (2, None, "k2", "s2"), (None, "plain", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, spans string")
    for f, word in ((secrets.redacted, "<SECRET>"), (pii.sanitised, "<EMAIL>")):
        got = f(df).collect()
        assert f(df).columns == df.columns and sorted((str(r["doc_id"]), str(r["key"]), str(r["spans"])) for r in got) == sorted((str(i), str(k), str(x)) for i, _, k, x in rows)
        assert sum(word in (r["text"] or "") for r in got) == 2 and {r["key"] for r in got} == {"k", "k2", None}


# --- decontamination -------------------------------------------------------------------------


def test_tiles_match_a_plain_search():
    def plain(a, b, least):
        free_a, free_b, out = [True] * len(a), [True] * len(b), []
        while True:
            best = (0, 0, 0)
            for i, j in itertools.product(range(len(a)), range(len(b))):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < least:
                return out
            out.append((i, j, n))
            free_a[i : i + n] = free_b[j : j + n] = [False] * n

    random.seed(10)
    for _ in range(60):
        a, b = ([random.randrange(4) for _ in range(random.randrange(30))] for _ in range(2))
        assert sum(n for *_, n in decontaminate.tiles(a, b, 3)) == sum(n for *_, n in plain(a, b, 3)), (a, b)
    item = list(range(100, 140))
    assert decontaminate.tiles([1, 2, *item[20:], 3, *item[:20], 4], item, 5) == [(23, 0, 20), (2, 20, 20)]


def test_tiles_use_what_longer_tiles_leave():
    def plain(a, b, least):
        used_a, used_b, out = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i, j in itertools.product(range(len(a)), range(len(b))):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < least:
                return sorted(out, key=lambda x: x[1])
            out.append((i, j, n))
            used_a.update(range(i, i + n))
            used_b.update(range(j, j + n))

    a, item = [*range(5, 14), -1, *range(8), -1, 19, -1, 19], list(range(20))
    assert decontaminate.tiles(a, item) == plain(a, item, 5) == [(10, 0, 5), (0, 5, 9)]
    random.seed(14)
    for _ in range(400):
        item = list(range(random.randrange(5, 30))) if random.random() < 0.7 else random.choices(range(3), k=20)
        a = []
        for _ in range(random.randrange(1, 6)):
            at = random.randrange(len(item))
            a += [*item[at : at + random.randrange(1, 12)], *([-1] if random.random() < 0.5 else [])]
        assert decontaminate.tiles(a, item, 3) == plain(a, item, 3), (a, item)


def test_leaks_are_found_and_clean_text_stays(spark):
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    items = [[word() for _ in range(24)] for _ in range(8)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "short one")], "item_id long, text string")
    noise = lambda n: [word() for _ in range(n)]
    texts = [" ".join(noise(300) + items[0] + noise(300)), " ".join(noise(5) + items[1][12:] + noise(9) + items[1][:12]).upper(), " ".join(noise(50) + items[2][:8] + noise(50)), " ".join(noise(400)), None, "", "A short, one."]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 1), (6, 92)}
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), bench).collect()} == {2, 3, 4, 5, 6}
    twice = bench.union(bench.where("item_id = 0"))
    odd = spark.createDataFrame([(None, texts[0], 1), (7, texts[0], 2), (7, texts[0], 3), (8, "x " * 90_000 + texts[1], 4)], "doc_id long, text string, item_id long")
    assert sorted(str((r["doc_id"], r["item_id"])) for r in decontaminate.contaminated(odd, twice).collect()) == ["(7, 0)", "(7, 0)", "(8, 1)", "(None, 0)"]
    assert decontaminate.clean(odd, twice).count() == 0 and decontaminate.clean(odd, twice).columns == odd.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark, texts), none).count() == 0 and decontaminate.clean(docs(spark, texts), none).count() == 7


# --- awkward rows, and the whole pipeline ----------------------------------------------------


def test_awkward_rows_have_a_result_everywhere(spark):
    df = awkward(spark)
    assert simhash.near_duplicates(df).count() == 8 and token_files.token_files(df).count() == 8 and mixing.taken(df).count() == 8
    assert secrets.secrets(df).count() == 8 and pii.personal(df).count() == 8
    kept = simhash.keep_one(df)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "None"] and kept.columns == df.columns
    assert mixing.mixed(df).columns == df.columns
    none = empty(spark)
    for f in (simhash.near_duplicates, simhash.keep_one, token_files.token_files, mixing.taken, mixing.mixed, secrets.secrets, pii.personal):
        assert f(none).count() == 0, f


def test_pipeline_stages_do_their_part(spark):
    import corpus_pipeline as C

    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {"start": {r["doc_id"] for r in df.select("doc_id").collect()}}
    for name, stage in C.STAGES[:-1]:
        df = common.saved(stage(spark, df, SMALL), name)
        kept[name] = {r["doc_id"] for r in df.select("doc_id").collect()}
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    names = list(kept)
    assert all(kept[b] <= kept[a] for a, b in itertools.pairwise(names))
    last = C.STAGES[-1][1](spark, df, SMALL)
    assert last.count() == df.count() and last.agg(F.sum("n_tokens")).first()[0] == last.orderBy(F.desc("start")).first()["start"] + last.orderBy(F.desc("start")).first()["n_tokens"]
