"""Near-dedup, line dedup, token output, language ID and quality classifier against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salescope.llm import components, langid, linededup, neardup, quality_clf, simple8b, tokens, wordhash
from tests.llm.data import LOWER, WORD, docs, empty, texts, words

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


# near duplicates

def brute_components(ts, k=4):
    sets = []
    for t in ts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(ts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(ts))}


def test_components_equal_brute_force(spark):
    ts = texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark)).collect()}
    assert got == brute_components(ts)


def chain(n, step=4, size=120):
    """Texts of which neighbours are alike and distant ones are not: every link counts."""
    rng = random.Random(1)
    w = ["w%d" % rng.randint(0, 10 ** 6) for _ in range(size)]
    out = []
    for i in range(n):
        out.append(" ".join(w))
        for j in range(step):
            w[(i * step + j) % size] = "n%d" % rng.randint(0, 10 ** 6)
    return out


def test_links_that_no_star_finds_are_found_in_blocks(spark):
    ts = chain(60) + chain(25, 3, 90) + texts()[:20]
    random.Random(4).shuffle(ts)
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    want = brute_components(ts)
    for block in (1024, 7):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(d, block=block).collect()}
        assert got == want


def test_one_of_each_stays(spark):
    d = docs(spark)
    kept = sorted(r["doc_id"] for r in neardup.keep_one_of_each(d.union(d.limit(4))).collect())
    assert kept == sorted(i for i, (_, c) in brute_components(texts()).items() if c == i)
    assert neardup.keep_one_of_each(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(nulls).collect()), key=str)
    assert got == [(3, 3, True), (None, 3, False), (None, None, True)]


def test_sketches_move_once_into_classes(spark, monkeypatch):
    """On tables of any size the landed sketches' signatures are read for the classes only, those of classes for buckets and one pick."""
    land, read = neardup.land, {}

    def folders(df):
        return {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in df.inputFiles()}

    def spy(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()  # its scans have the columns read only
        if "sig#" in plan or "bands#" in plan:
            read[name] = folders(df)
        return land(df, name)

    monkeypatch.setattr(neardup, "land", spy)
    monkeypatch.setattr(neardup, "PICK_ROWS", 0)
    ts = [*chain(12), "a b c d e", "A b c d e", None]
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(d).collect()}
    assert got == brute_components(ts)
    assert [n for n, x in read.items() if "llm-dup-sketch" in x] == ["dup-classes"]
    assert [n for n, x in read.items() if "llm-dup-classes" in x] == ["dup-members", "dup-prints"]


def test_connected_components_on_paths_stars_and_rings(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(80)] + [(900 + i, 900 + (i + 1) % 30) for i in range(30)]
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 581)}, **{i: 900 for i in range(900, 930)}}


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.text("ab \t\né", max_size=30), min_size=1, max_size=20), st.integers(1, 40))
def test_word_hashes_do_not_depend_on_place(ts, limit):
    names = {}
    for first, end, data, offsets in wordhash.chunks(pa.array(ts), limit):
        s, e, bounds = wordhash.words(data, offsets)
        h = wordhash.span_hashes(data, s, e)
        for i in range(first, end):
            own = h[bounds[i - first]:bounds[i - first + 1]].tolist()
            assert len(own) == len(words(ts[i]))
            for w, x in zip(words(ts[i]), own, strict=True):
                assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


# line dedup

def brute_lines(ts, n):
    first, out = set(), {}
    for i, t in enumerate(ts):
        lines, gone = (t or "").split("\n"), set()
        for j in range(max(len(lines) - n, 0) + 1):
            w = tuple(lines[j:j + n])
            if not any(words(x) for x in w):
                continue
            if w in first:
                gone |= set(range(j, j + len(w)))
            first.add(w)
        out[i] = (len(lines), sorted(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_runs_equal_brute_force(spark, run):
    ts = texts()
    ts += [ts[3] + "\n" + ts[4], "head\n" + (ts[6] or ""), "a\nb\nc\na\nb\nc\na\nb", "\n\n\n"]
    d = docs(spark, ts[len(texts()):])
    got = {r["doc_id"]: (r["n_lines"], list(r["removed"]), r["text"]) for r in linededup.dedup_lines(d, run).collect()}
    assert got == brute_lines(ts, run)


def test_a_long_line_goes_alone_and_a_short_one_does_not(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    ts = [f"a\n{long}\nb\n{short}", f"c\n{long}\nd", f"e\n{short}\nf", long, short, short, f"{long}\n{long}", f"\n \n{long}\n\n"]
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["removed"]) for r in linededup.dedup_lines(d).collect()}
    assert got == {0: [], 1: [1], 2: [], 3: [0], 4: [], 5: [0], 6: [0, 1], 7: [2]}


def test_runs_are_extended_from_their_first_place(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(linededup, "PLACES", 3)
    lines = ["alpha", "beta", "", " ", "gamma delta", "epsilon", "one two three"]
    ts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    for n in (2, 3):
        got = {r["doc_id"]: (r["n_lines"], list(r["removed"]), r["text"]) for r in linededup.dedup_lines(d, n).collect()}
        assert got == brute_lines(ts, n)


def test_line_dedup_of_empty_and_repeated_rows(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a\nb")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["text"]) for r in linededup.dedup_lines(same).collect())
    assert got == [(False, ""), (False, ""), (True, "a\nb")]


# Simple-8b and tokens

@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2 ** 64 - 1), st.just(0)), max_size=400))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    assert simple8b.decode(simple8b.encode(x), len(x)).tolist() == values


def test_simple8b_packs_tightly_and_blocks_round_trip():
    assert len(simple8b.encode(np.zeros(1200, np.uint64))) == 10
    assert len(simple8b.encode(np.ones(600, np.uint64))) == 10
    assert len(simple8b.encode(np.full(300, 50_000, np.uint64))) == 100
    ids, lengths = np.arange(5000, dtype=np.uint64), np.array([0, 1, 4999])
    back, offsets = simple8b.unpack_block(simple8b.pack_block(ids, lengths))
    assert back.tolist() == ids.tolist() and offsets.tolist() == [0, 0, 1, 5000]


def reference_ids(ts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids for x in ts]


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.text(st.one_of(st.sampled_from("  \n\t'smtdrevlaé1½.,'\x85\xa0\x1cª"), st.characters(max_codepoint=0x250, exclude_categories=["Cs"]),
                                  st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=8))
def test_pieces_equal_the_tokenizer(ts):
    encoder = tokens.per_process("test encoder", lambda: tokens.PieceEncoder(TOKENIZER))
    assert [x.tolist() for x in encoder.encode(ts)] == reference_ids(ts)


def test_piece_cache_may_be_dropped(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 20)
    monkeypatch.setattr(tokens, "MERGE_PIECES", 5)
    encoder = tokens.PieceEncoder(TOKENIZER)
    ts = [t for t in texts() if t][:30]
    for t in ts:
        assert encoder.encode([t])[0].tolist() == reference_ids([t])[0]


def test_token_files_hold_all_ids_in_order(spark):
    ts = [*texts(), "<|endoftext|> it's  we'll 'S", "日本語 text"]
    d = docs(spark, ts[len(texts()):])
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_output(d.repartition(7), TOKENIZER).collect()}
    start = 0
    for i, ids in enumerate(reference_ids(ts)):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert got[i] == (start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1
    assert tokens.token_output(empty(spark), TOKENIZER).count() == 0


# classifiers

LANGS = {"xx": ["kor", "vati", "lumo", "pesk", "tira"], "yy": ["qua", "esse", "bono", "dolce", "viva"], "zz": ["ñor", "güe", "éte", "ção", "ähn"]}


def spoken(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        out.append((i, " ".join("".join(rng.choices(LANGS[lang], k=2)) for _ in range(rng.randint(3, 40))), lang if i % 7 else None))
    return out


def test_language_id_on_unseen_documents(spark):
    rows = spoken(240) + [(900, None, "xx"), (901, "", "xx"), (902, "123 !!", "xx"), (None, "kor vati", None)]
    d = spark.createDataFrame([(*r, "s", "x") for r in rows], "doc_id long, text string, lang string, source string, draw string")
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    for i, _, _ in rows[:240]:
        assert got[i]["lang_pred"] == sorted(LANGS)[i % 3] and 0.5 < got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    kept = langid.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == 241
    assert langid.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(d.withColumn("lang", d.lang.substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}


def test_presence_kernel_counts_common_grams():
    def grams(t):
        t = "".join(c.lower() if c.isalpha() else " " for c in t)
        return {t[i:i + n] for n in langid.GRAMS for i in range(len(t) - n + 1)}
    a, b = "Hello world", "yellow würld 12"
    x, has = langid.presence([a, b, "", "12"])
    assert has.tolist() == [True, True, False, False]
    assert abs(int((x[0] & x[1]).sum()) - len(grams(a) & grams(b))) <= 1
    assert abs(int(x[0].sum()) - len(grams(a))) <= 1


def test_quality_classifier_generalises_and_is_deterministic(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w) + "." if good else " | ".join(w) + " !!"))
        labels.append((i, int(good), 0))
    rows += [(500, None), (501, ""), (None, "x")]
    labels += [(500, None, 1), (None, 0, 0), (3, 1, 0)]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, y double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality_clf.classify(d, lab).collect()}
    assert len(first) == len(rows) and all(0 <= s <= 1 for s, _ in first.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(first[i][1] == int(i % 4 != 0) for i in held) >= 0.98 * len(held)
    assert first == {r["doc_id"]: (r["score"], r["predicted"]) for r in quality_clf.classify(d.repartition(3), lab).collect()}
    assert quality_clf.classify(empty(spark), lab).count() == 0
    assert {r["score"] for r in quality_clf.classify(d, lab.limit(0)).collect()} == {0.5}
