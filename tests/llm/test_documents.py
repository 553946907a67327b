"""Operators on documents against brute force, with nulls, empty texts, ties and repeats."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.llm import license, linededup, minhash, mixing, packing, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `_size` long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def make(spark, rows):
    """rows: (doc_id, text); the other columns clash with names that operators might use."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "   \n\n "), (None, "one two"), (5, "one two"), (5, "one two"), (7, "long " * 30_000), (8, "x" * 100_000)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_is_levenshtein_within_the_bound():
    rng = random.Random(3)
    for t in range(600):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        b = [x for x in a if rng.random() > 0.1] if t % 2 else [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        most = rng.randrange(0, 15)
        assert minhash.distance(np.array(a, dtype="u4"), np.array(b, dtype="u4"), most) == min(edit(a, b), most + 1)


def test_crowds_of_unlike_texts_lose_no_link(spark, monkeypatch):
    """Texts of slots with two variants each: every part stands in half of the texts, so no k-mer is rare."""
    monkeypatch.setattr(minhash, "MOST_TEXTS", 40)  # several blocks
    rng = random.Random(9)
    slots = [[prose(rng, 20) for _ in range(2)] for _ in range(16)]
    picks = [tuple(rng.randrange(2) for _ in slots) for _ in range(220)]
    rows = [(i, " ".join(s[v] for s, v in zip(slots, p))) for i, p in enumerate(picks)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(picks):
        for j in range(i):
            if sum(a != b for a, b in zip(p, picks[j])) <= 3:  # 60 of 320 words
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r._class for r in minhash.classified(make(spark, rows)).select("doc_id", "_class").collect()}
    assert got == {i: find(i) for i in range(len(rows))} and 3 < len(set(got.values())) < 200


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    rows, passage = [], prose(rng, 60)
    for base in range(12):
        words = prose(rng, rng.randrange(60, 200)).split()
        for copy in range(rng.randrange(1, 5)):
            w = list(words)
            for _ in range(copy * 2):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    # a crowd that shares a passage, with two near copies in it
    crowd = [prose(rng, 60) for _ in range(50)]
    rows += [(1000 + i, f"{c} {passage}") for i, c in enumerate(crowd)] + [(2000, f"{crowd[3]} new {passage}")]
    rows += [(3000 + i, rows[0][1]) for i in range(30)] + ODD
    got = {(r.doc_id, r.text): r for r in minhash.classified(make(spark, rows)).select("doc_id", "text", "_class", "_first").collect()}
    texts = sorted({t or "" for _, t in rows})
    words = [minhash.WORD.findall(t.lower()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    for i in range(len(texts)):
        for j in range(i):
            most = int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
            if words[i] and words[j] and grams[i] & grams[j] and max(len(words[i]), len(words[j])) < 1000 and edit(words[i], words[j]) <= most:
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, t in rows:
        c = find(texts.index(t or ""))
        least[c] = min(least[c], 1 << 60 if i is None else i)
    for i, t in rows:
        r = got[i, t]
        assert r["_class"] == least[find(texts.index(t or ""))], (i, r["_class"])
    kept = minhash.one_of_each(make(spark, rows))
    assert kept.columns == make(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_band_equals_whole_columns(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    for _ in range(1500):
        a = [rng.randrange(5) for _ in range(rng.randrange(60, 200))]
        b, most = list(a), rng.randrange(1, 12)
        for _ in range(rng.randrange(0, 14)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(2)] = [rng.randrange(5)] * rng.randrange(2)
        if abs(len(a) - len(b)) <= most:
            assert minhash._in_band(a, b, most) == min(minhash._columns(a, b, 10**6), most + 1)


def test_pairs_in_a_crowd_and_drifting_copies_are_found(spark):
    rng = random.Random(31)
    passage, rows, want = prose(rng, 150), [], []
    for i in range(80):  # own words beside a passage that all share; every second text has a near copy
        own = prose(rng, 50).split()
        rows.append((10 * i, f"{' '.join(own)} {passage}"))
        if i % 2:
            for j in rng.sample(range(50), rng.choice([10, 15, 20])):
                own[j] = prose(rng, 1) + "q"
            rows.append((10 * i + 1, f"{' '.join(own)} {passage}"))
            want.append((10 * i, 10 * i + 1))
    drift, n = prose(rng, 200).split(), 10_000
    for i in range(60):  # each a few words further from the first
        drift = [prose(rng, 1) + "z" if rng.random() < 0.02 else w for w in drift]
        rows.append((n + i, " ".join(drift)))
    of = {r.doc_id: r["_class"] for r in minhash.classified(make(spark, rows)).select("doc_id", "_class").collect()}
    # texts of one passage and 50 own words differ in a quarter of their words, or more
    assert sum(of[a] == of[b] for a, b in want) >= 0.95 * len(want)
    assert len({of[10 * i] for i in range(80)}) == 80
    assert {of[n + i] for i in range(60)} == {n}


def test_near_duplicates_of_nothing(spark):
    assert minhash.classified(make(spark, [])).count() == 0
    assert minhash.one_of_each(make(spark, [])).count() == 0


def test_recall_of_sketches():
    rng = np.random.default_rng(1)
    hit = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 30, 200).astype("u4")
        b = a.copy()
        b[rng.choice(200, 20, replace=False)] = 7  # nine tenths of the words stay
        hit += bool(set(minhash.sketches(minhash.kmers(a))[0]) & set(minhash.sketches(minhash.kmers(b))[0]))
    assert hit >= 190


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_of_sketches_down_to_the_declared_similarity(similarity):
    rng = np.random.default_rng(21)
    hit = 0
    for _ in range(300):
        n = int(rng.integers(200, 501))
        a = rng.integers(0, 1 << 30, n).astype("u4")
        b = a.copy()
        changed = rng.choice(n, int((1 - similarity) * n + 1e-9), replace=False)
        b[changed] = rng.integers(0, 1 << 30, len(changed))
        hit += bool(set(minhash.sketches(minhash.kmers(a))[0]) & set(minhash.sketches(minhash.kmers(b))[0]))
    assert hit >= 0.95 * 300


def brute_lines(rows):
    """Rows with texts; later windows by (key, hash order) lose their lines."""
    seen, out = {}, {}
    order = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a in range(len(full) - 2):
            key = tuple(lines[full[a + j]] for j in range(3))
            if key in seen:
                gone |= {full[a + j] for j in range(3)}
            else:
                seen[key] = i
        out[i, t] = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d e", " "]) for _ in range(rng.randrange(0, 14)))) for i in range(150)]
    rows += [(500 + i, "same 1\nsame 2\nsame 3\nsame 4") for i in range(40)] + [(900, None), (901, ""), (902, "x\n" * 3000)]
    got = {(r.doc_id, r.text): r["_text"] for r in linededup.deduped(make(spark, rows)).select("doc_id", "text", "_text").collect()}
    assert got == brute_lines(rows)
    assert linededup.deduped(make(spark, ODD)).count() == len(ODD)
    assert linededup.deduped(make(spark, [])).count() == 0


def test_packing_is_whole_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 900))) for i in range(60)] + ODD + [(70, "hello <|endoftext|> world"), (71, "a  <|endoftext|>\n\n b  c")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.packed_documents(make(spark, rows), path).toPandas()
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        head = len(ids) % 2048 or min(2048, len(ids))
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    key = got["key"].astype("object").where(got["key"].notna(), None)
    assert Counter(zip(key, got["piece"], got["start"], got["length"], got["ids_crc32"])) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 2048) * 1.05 + 1
    assert packing.packed_documents(make(spark, []), path).count() == 0


def test_ids_equal_a_plain_encode_for_every_code_point():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, ours = Tokenizer.from_file(path), packing.Encoder(path)
    plain = lambda x: t.encode(x, add_special_tokens=False).ids
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # each character between letters, marks, digits and white space, many to a text
    for form in ("a{0}b !{0}! ", "1{0}{0} y{0}'s\n"):
        texts = ["".join(form.format(c) for c in chars[i : i + 512]) for i in range(0, len(chars), 512)]
        for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
            if ours(x).tolist() != e.ids:
                assert False, [hex(ord(c)) for c in chars[texts.index(x) * 512 :][:512] if ours(form.format(c)).tolist() != plain(form.format(c))]
    rng = random.Random(20)
    signs = "a b é ñ 1 ' s . , ! \n \t \x1c \xa0 \u2003 中 ़ ٣ 😀 <|endoftext|>".split(" ") + [" ", "  "]
    for _ in range(3000):
        x = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 30)))
        assert ours(x).tolist() == plain(x), x


@pytest.mark.parametrize("block", [packing.BLOCK_BYTES, 200])
def test_texts_together_have_the_ids_of_a_plain_encode(block, monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK_BYTES", block)  # a long text is more than a block
    monkeypatch.setattr(packing, "SLICE_PARTS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, ours, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(21)
    signs = "a b é ñ 1 ' s . , ! \n \t \x1c \x85 \xa0 \u2003 中 ़ ٣ 😀 <|endoftext|> word".split(" ") + [" "] * 6
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 30))) for _ in range(4000)]
    texts += [None, "", " ", "  ", "   ", "a  ", "a  b", "a   b", " a", "  a", "a \n \n b", "a \xa0 ", "x y " * 500, "z" * 3000, " " * 3000]
    for kind in (pa.string(), pa.large_string()):
        got = list(ours.each(pa.array(texts, kind)))
        assert len(got) == len(texts)
        for x, ids in zip(texts, got):
            assert ids.tolist() == t.encode(x or "", add_special_tokens=False).ids, x
    assert list(ours.each(pa.array([], pa.string()))) == [] and [len(x) for x in ours.each(pa.array([None, None], pa.string()))] == [0, 0]


def test_a_word_that_many_texts_hold_is_looked_up_once():
    import public_tokenizers
    import pyarrow as pa

    ours, asked = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), Counter()

    class Counted(packing.ChunkIds):
        def __getitem__(self, chunk):
            asked[chunk] += 1
            return super().__getitem__(chunk)

    ours.known = Counted(ours.tokenizer)
    assert all(ids.tolist() == ours("one two three two").tolist() for ids in ours.each(pa.array(["one two three two"] * 300)))
    asked.clear()
    list(ours.each(pa.array(["one two three two"] * 300)))
    assert asked[" two"] == asked[" three"] == 1


def fewest(xs, capacity):
    """The least number of bins, by trying all."""
    xs, best = sorted(xs, reverse=True), [len(xs)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(xs):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + xs[i] <= capacity:
                rest = list(bins)
                rest[rest.index(b)] += xs[i]
                place(i + 1, rest)
        place(i + 1, [*bins, xs[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_least_number_of_bins():
    rng = random.Random(15)
    three = 0
    for _ in range(500):
        xs = [rng.randrange(4, 31) for _ in range(rng.randrange(1, 10))]
        rest = Counter(xs)
        fixed = packing.reduce_histogram(rest, 30)
        three += any(len(p) == 3 for p, _ in fixed)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(left, 30) == fewest(xs, 30), xs
    assert three > 50


def test_patterns_use_every_piece_once():
    rng = random.Random(6)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 60) for _ in range(rng.randrange(0, 200)))
        made = Counter()
        bins = 0
        for pattern, n in packing.patterns(dict(counts), 60):
            assert sum(pattern) <= 60
            bins += n
            for x in pattern:
                made[x] += n
        assert made == counts
        assert bins <= 11 / 9 * np.ceil(sum(x * n for x, n in counts.items()) / 60) + 2


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", None, "é"])) for i in range(3000)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows] + [(None, None, "a", 1)], "doc_id long, text string, source string, size long")
    out = mixing.mixed(df).toPandas()
    sizes = out.groupby("source", dropna=False)["_size"].sum()
    names = sorted((s for s in sizes.index if isinstance(s, str)), key=lambda s: s.encode()) + [None]
    weight = dict(zip(names, (5, 2, 1) * 9))
    size = {s: int(out.loc[out["source"].isna() if s is None else out["source"] == s, "_size"].sum()) for s in names}
    target, free, rest = {}, list(names), float(sum(size.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
            free.remove(s)
    for s in names:
        own = out[out["source"].isna() if s is None else out["source"] == s]
        assert own["_target"].iloc[0] == pytest.approx(target[s])
        assert abs((own["_size"] * own["_copies"]).sum() - target[s]) <= own["_size"].max()
        assert own["_copies"].max() <= 3
    assert mixing.mixed(df.limit(0)).count() == 0


def counts_of(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {p + j for ps in at.values() if len(ps) > 1 for p in ps for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a ", "b ", "c", "\n", "# ", "$", "é ", "\t"]) for _ in range(rng.randrange(0, 120))) for _ in range(200)]
    df = make(spark, list(enumerate(texts)) + ODD)
    for r in quality.features(df).select("text", "_q.*").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_of(r.text)


def test_quality_certifies_by_the_exact_binomial(spark):
    from math import comb

    df = spark.createDataFrame([(n, k) for n in (0, 50, 300, 900) for k in (0, 1, 3)], "n long, k long")
    got = df.withColumn("ok", quality.certified(F.col("n"), F.col("k"), 0.01, F.lit(0.05))).collect()
    for r in got:
        tail = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.ok == (r.n > 0 and r.k <= 0.01 * r.n and tail <= 0.05), r


def test_quality_without_labels_keeps_what_the_base_keeps(spark):
    rng = random.Random(1)
    df = make(spark, [(i, prose(rng, 80)) for i in range(5)] + ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.kept_documents(df, labels)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_license_base_places_equal_brute_force(spark):
    rng = random.Random(10)
    vocabulary = "under the mit license apache version 2 cc by nc The MIT, License. é".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["Under  the\nMIT-license; under the mit license", "cc by ncx cc by nc", "licensed undr the apache licence version 2"]
    df = make(spark, list(enumerate(texts)) + ODD)
    out = license.scanned(df).select("text", "_n_words", "_spans", *[c.alias(n) for n, c in license.digest(F.col("_spans")).items()]).collect()
    for r in out:
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")]
        at = sorted((i, label) for phrase, label in license.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
        assert (r["_n_words"], r.n_base) == (len(words), len(at)), r.text
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None)), r.text
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    fuzzy = next(r for r in out if r.text and r.text.startswith("licensed undr"))
    assert "apache-2" in fuzzy.labels and fuzzy.n_base == 0


def test_license_edits_never_name_another_license():
    scan = license.Scanner().scan
    labels = lambda text: {label for label, *_ in scan(text)[1]}
    for text, want in (
        ("under the mit license", {"mit"}), ("under thr mit licence", {"mit"}), ("under the bit license", set()), ("under the mitt license", set()),
        ("apache license version 2", {"apache-2"}), ("apache licence versiom 2", {"apache-2"}), ("apache license version 1", set()), ("apache license version 21", set()), ("apaches license version 2", set()),
        ("cc by nc", {"cc-by-nc"}), ("cc by sa", set()), ("gnu lesser general public license", {"lgpl"}), ("gnu afero general public license", set()), ("the gnu general public licence", {"gpl"}),
        ("the general public was licensed to reserve all rights", set()),
    ):
        assert labels(text) == want, text
    rng = random.Random(14)
    assert not any(labels(prose(rng, 400)) for _ in range(50))
    # an edit anywhere but in a name is found, whichever character it takes
    for phrase, label in (*license.BASE, *license.NOTICES):
        if len(phrase) >= license.CHARS_PER_EDIT:
            for i in range(1, len(phrase)):
                word = len(phrase[: i + 1].split()) - 1
                if phrase[i] != " " and phrase.split()[word] not in license.NAMES:
                    assert label in labels(f"so {phrase[:i]}#{phrase[i + 1 :]} then".replace("#", "x")), (phrase, i)


def test_toxic_segments_equal_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        s = [rng.choice([-2.0, -1.0, 1.0, 2.0, 3.0]) for _ in range(rng.randrange(0, 20))]

        def best(a, b):  # Ruzzo and Tompa: the best segment, then left and right of it
            if a >= b:
                return []
            top = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)))
            if top[0] <= 0:
                return []
            return best(a, top[3]) + [(top[3], top[4], top[0])] + best(top[4], b)

        got = toxicity.segments(np.array(s))
        assert [x[2] for x in got] == [x[2] for x in best(0, len(s))]


def test_toxicity_scores_held_out_documents(spark):
    rng = random.Random(12)
    bad = ["hateful", "wretched", "vermin"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            words[30:34] = [rng.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 50 == 7 else 1, 1 if i % 4 == 0 else 0))
    df = make(spark, rows + [(None, None), (700, ""), (701, "z " * 50_000)])
    marked = spark.createDataFrame(labels + [(None, 1, None), (5, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marked.where(toxicity.fold_of(F.col("doc_id")) != 0))
    out = toxicity.scored(df, model).where(F.coalesce(toxicity.fold_of(F.col("doc_id")) == 0, F.lit(True))).collect()
    right = [(r["_score"] >= 0.5) == (r.doc_id % 4 == 0) for r in out if r.doc_id is not None and r.doc_id < 600]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["_score"] <= 1 for r in out)
    assert toxicity.scored(make(spark, []), toxicity.fit(make(spark, []), marked)).count() == 0


def test_toxicity_keeps_rare_words_that_clean_texts_lack(spark):
    rng = random.Random(13)
    bad = ["trash", "scum", "loser", "clown"]  # each 3e-4 of all words
    rows, labels = [], []
    for i in range(1200):
        words = prose(rng, 150).split()
        if i % 4 == 0:
            words[50] = words[51] = bad[i // 4 % 4]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    df = make(spark, rows + [(5000 + i, prose(rng, 150)) for i in range(2400)])
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(w in model.weights and model.weights[w][0] > 0 for w in bad)
    out = toxicity.scored(df.where("doc_id < 1200"), model).collect()
    best = {r.doc_id: r["_score"] for r in out}
    wins = [(best[i] > best[j]) + (best[i] == best[j]) / 2 for i in range(0, 1200, 4) for j in range(1, 1200, 4)]
    assert sum(wins) / len(wins) > 0.9
