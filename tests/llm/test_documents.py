"""Each operator on documents against a plain version, on odd rows and on the small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.llm import common, licenses, sentencepiece, tokens, toxicity
from millrace.llm.jaccard import jaccard_components
from millrace.llm.language_model import cross_entropy_difference
from millrace.llm.line_runs import line_dedup
from millrace.llm.packing import pack_documents
from millrace.llm.queries import tokenizer_path
from millrace.llm.substring import substring_dedup
from millrace.llm.tokens import word_encoder

from .conftest import SMALL, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_substring(rows, window):
    first, found = {}, {}
    known = {(i, t) for i, t in rows if i is not None and t is not None}
    for i, t in sorted(known):
        w = WORD.findall(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] != (i, k):
                gone.update(range(k, k + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        found.setdefault((i, t), (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(((i, *found[i, t]) for i, t in rows), key=repr)


def test_substring_dedup(odd, no_documents, rows):
    got = rows(substring_dedup(odd, 20), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == plain_substring(odd_rows(), 20)
    assert substring_dedup(no_documents, 20).collect() == []


def test_substring_dedup_deals_out_a_frequent_phrase(spark, rows):
    from millrace.llm.substring import hot_anchors

    from .conftest import words

    phrase, copied = " ".join(words(70, 10)), " ".join(words(71, 60))
    texts = []
    for k in range(150):  # one phrase, each time between other words
        around = [" ".join(words(1000 + 2 * k + j, 25, 10**6)) for j in (0, 1)]
        texts.append((k, f"{around[0]} {phrase} {around[1]}" + (f" {copied}" if k % 9 == 0 else "")))
    texts += [(200 + k, texts[k][1]) for k in range(0, 150, 10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    expected = plain_substring(texts, 20)
    assert any(n for _, _, n, _ in expected)
    for hot_bytes in (0, 2_000, 1 << 20):
        found = substring_dedup(docs, 20, hot_bytes=hot_bytes)
        assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    segments = [(0, 7, bytes([k]), bytes(100)) for k in range(30)] + [(0, 8, b"x", bytes(100))] * 50
    segments += [(0, 7, b"a", None)]
    segments = spark.createDataFrame(
        segments, "bucket int, key int, segment_id binary, segment binary"
    )
    assert [tuple(r) for r in hot_anchors(segments, 2_000).collect()] == [(0, 7)]


def test_substring_query(spark, rows, small_texts):
    assert rows(queries()["op1_substring_dedup"](spark, SMALL)) == plain_substring(small_texts, 20)


def plain_lines(rows, least, least_words=None):
    """Every run of ``least`` lines, or of fewer with so many words, that starts earlier too."""
    first, out = {}, []
    split = {}
    sizes = range(1 if least_words else least, least + 1)

    def runs(kept):
        for size in sizes:
            for k in range(len(kept) - size + 1):
                run = tuple(x for _, x in kept[k : k + size])
                if size == least or len(WORD.findall("\n".join(run))) >= least_words:
                    yield k, run

    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        kept = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\f\v")]
        split[i, t] = kept
        for k, run in runs(kept):
            first.setdefault(run, (i, t, k))
    for i, t in rows:
        kept, gone = split.get((i, t), []), set()
        for k, run in runs(kept):
            if first[run] != (i, t, k):
                gone.update(p for p, _ in kept[k : k + len(run)])
        if t is not None and gone:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out.append((i, t, len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 3])
def test_line_dedup(odd, no_documents, rows, least):
    got = rows(line_dedup(odd, least), "doc_id", "text", "n_removed")
    assert got == plain_lines(odd_rows(), least)
    assert line_dedup(no_documents, least).collect() == []


def lines_of(seed, n, stock=12):
    """Texts of few different lines, short and long ones, with shared runs of any length."""
    import random

    rng = random.Random(seed)
    known = [" ".join(f"w{seed}{k}" for k in range(rng.choice((1, 3, 9, 25)))) + f" {j}" for j in range(stock)]
    runs = [[rng.choice(known) + f" r{j}" for _ in range(rng.randrange(1, 40))] for j in range(6)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            run = rng.choice(runs)
            start = rng.randrange(len(run))
            lines += run[start : rng.randrange(start, len(run)) + 1]
            lines += [f"own {i} {k}" for k in range(rng.randrange(3))] + [""] * rng.randrange(2)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("least, least_words", [(1, None), (2, 4), (3, 20), (5, None), (6, 30)])
def test_line_dedup_by_lines_or_words(spark, rows, least, least_words):
    texts = [*lines_of(least, 60), *odd_rows()]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(texts)], "doc_id long, text string, line int")
    found = line_dedup(docs.repartition(4), least, min_words=least_words, keep=["line", "doc_id"])
    assert rows(found, "doc_id", "text", "n_removed") == plain_lines(texts, least, least_words)
    assert sorted(r.row.line for r in found.select("row").collect()) == list(range(len(texts)))
    strings = docs.withColumn("doc_id", F.format_string("%08d", "doc_id"))
    cut = line_dedup(strings.filter("doc_id >= '0'"), least, min_words=least_words)
    known = [(f"{i:08d}", t) for i, t in texts if i is not None and i >= 0]
    assert rows(cut, "doc_id", "text", "n_removed") == plain_lines(known, least, least_words)


def test_repeated_runs(spark):
    """Each run found stands at both places and ends where they differ; none of them is short
    of the longest run by half."""
    from millrace.llm import line_runs
    from millrace.llm.common import Scratch

    texts = lines_of(5, 40)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    scratch = Scratch(spark)
    lines = scratch.keep(line_runs.line_sequence(docs, scratch))
    text = {r.id: r.name for r in lines.collect()}
    owner = {r.id: r.doc_id for r in lines.collect()}
    runs = line_runs.repeated_runs(line_runs.suffix_ranks(lines, scratch), scratch).collect()

    def common(i, j):
        n = 0
        while i + n in text and text[i + n] == text.get(j + n):
            n += 1
        return n

    longest, found = Counter(), Counter()
    for i in text:
        longest[owner[i]] = max(longest[owner[i]], *(common(i, j) for j in text if j <= i and j != i), 0)
    for r in runs:
        assert r.earlier < r.id and common(r.id, r.earlier) == r.lines
        found[owner[r.id]] = max(found[owner[r.id]], r.lines)
    assert max(found.values()) > 16
    for doc, n in longest.items():
        assert n >= found[doc] and 2 * found[doc] > n or n == found[doc] == 0
    dedup = {r.doc_id: r for r in line_runs.line_dedup(docs, 1).collect()}
    assert all(dedup[d].longest_run == found[d] for d in found)


def test_line_query(spark, rows, small_texts):
    got = rows(queries()["op5_line_dedup"](spark, SMALL), "doc_id", "n_removed", "kept_sha256")
    expected = [
        (i, n, hashlib.sha256(t.encode()).hexdigest())
        for i, t, n in plain_lines(small_texts, 3, 20)
    ]
    assert got == sorted(expected, key=repr)


def plain_components(rows, size, percent):
    sets = defaultdict(list)
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or (
            {tuple(w)} if w else set()
        )
        sets[i].append(grams)
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i in ids:
        for g in sets[i][0]:
            holders[g].add(i)
    shared = Counter()
    for members in holders.values():
        shared.update((i, j) for i in members for j in members if i < j)
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i][0]) + len(sets[j][0]) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return sorted(
        ((i, len(s), root(i) if i is not None else None) for i in sets for s in sets[i]), key=repr
    )


def test_jaccard_components(odd, no_documents, rows):
    assert rows(jaccard_components(odd, 4, 85)) == plain_components(odd_rows(), 4, 85)
    assert jaccard_components(no_documents).collect() == []


def test_near_copies_that_only_chains_join(spark, rows):
    from .conftest import words

    base, texts = words(9, 300, 5000), []
    for k in range(60):  # each differs from the next by a word; the ends are far apart
        base = base[:]
        base[5 * k % 300] = f"new{k}"
        texts.append((100 - k, " ".join(base)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows(jaccard_components(docs, 4, 85))
    assert got == plain_components(texts, 4, 85)
    assert {c for _, _, c in got} == {41}


def test_jaccard_query(spark, rows, small_texts):
    got = rows(queries()["op10_ngram_jaccard_join"](spark, SMALL))
    assert got == plain_components(small_texts, 4, 85)


def check_packing(found, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected, used = [], defaultdict(list)
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            expected.append((i, k, start, len(part), zlib.crc32(part.tobytes())))
    got = [tuple(r)[:5] for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    for r in found:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(used), -(-sum(e[3] for e in expected) // capacity)


def test_packing(odd, no_documents):
    path = tokenizer_path("word_bpe_49k.json")
    for capacity in (64, 2048):
        sequences, least = check_packing(
            pack_documents(odd, path, capacity).collect(), odd_rows(), capacity
        )
        assert sequences <= least + 1
    assert pack_documents(no_documents, path).collect() == []


def test_packing_query(spark, small_texts):
    found = queries()["op3_best_fit_packing"](spark, SMALL).collect()
    sequences, least = check_packing(found, small_texts, 2048)
    assert sequences <= least + 1


def plain_licenses(rows):
    out = []
    for i, t in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        starts, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += here
            labels |= {label} if here else set()
        ends = (min(starts, default=None), max(starts, default=None))
        out.append((i, len(w), len(starts), *ends, ",".join(sorted(labels))))
    return sorted(out, key=repr)


BASE_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_license_scan(odd, no_documents, rows):
    found = licenses.license_scan(odd)
    assert rows(found, *BASE_COLUMNS) == plain_licenses(odd_rows())
    for r in found.collect():
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.license_scan(no_documents).collect() == []


def test_license_notices(spark):
    texts = [t.words.title() for t in licenses.NOTICES] + ["licensed under nothing", "all rights"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for k, template in enumerate(licenses.NOTICES):
        assert template.label in found[k].labels.split(",") and found[k].score > 0.99
    assert [found[k].labels for k in (len(texts) - 2, len(texts) - 1)] == ["", ""]


def test_full_notices_with_changes(spark):
    """Words put in, left out and changed; a file with two notices; one without a key phrase."""
    mit, bsd = (text for label, text, _ in licenses.FULL_NOTICES if label in ("mit", "bsd"))
    changed = mit.replace("free of charge", "free of any charge").replace("publish, ", "")
    changed = "Copyright 2020 Some One\n" + changed.replace("AUTHORS", "SOME ONE")
    without = mit.replace("without restriction", "with some restriction")
    both = "# " + "\n# ".join((mit + "\n and, for a part of it,\n" + bsd).split("\n"))
    filler = " ".join(f"word{k}" for k in range(3_000))
    texts = [changed, without, both, filler + mit + filler, mit.replace(" ", " x ")]
    others = [f"some other text of the kind {k}" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    full = len(licenses.license_words(mit.encode()))
    long_ones = {
        k: [p.label for p in r.places if p.share > 0.9 and p.label in ("mit", "bsd")]
        for k, r in found.items()
    }
    assert "mit" in found[0].labels.split(",") and found[0].score > 0.9
    starts = {p.start for p in found[2].places if p.label == "bsd"}
    assert found[2].labels == "bsd,mit" and starts == {full + 6}
    assert found[3].labels == "mit" and {p.start for p in found[3].places} == {2_999 + 1}
    assert long_ones[0].count("mit") == 2 and long_ones[1].count("mit") == 1  # the short one stays
    assert found[4].labels == ""


def test_rarest_words_of_the_file_choose():
    templates = licenses.NOTICES
    vocabulary = {w for t in templates for w in t.words.split()}
    common = {"the", "of", "and", "to", "in", "software", "or", "is", "a", "this"}
    idf = {w: 0.1 if w in common else 5.0 for w in vocabulary}
    index = licenses.Index(templates, idf)
    tried = []
    plain = index.aligned
    index.aligned = lambda k, places: tried.append(k) or plain(k, places)
    found, _ = index.scan(b"x all rights reserved of the software".split())
    assert [(templates[k].label, start) for k, start, _ in found] == [("reserved", 1)]
    # "reserved" is the rarest word and explains all that is left but common words.
    assert templates[tried[0]].label == "reserved"


def test_license_query(spark, rows, small_texts):
    found = queries()["op4_license_scans"](spark, SMALL)
    assert rows(found, *BASE_COLUMNS) == plain_licenses(small_texts)


MODEL = tokenizer_path("piece_bpe_32k.model")


def plain_viterbi(pieces, text):
    """The highest score of a segmentation."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - pieces.longest), end):
            score = pieces.score.get(text[begin:end], (None,))[0]
            if score is None and begin == end - 1:
                score = pieces.foreign
            if score is not None:
                best[end] = max(best[end], best[begin] + score)
    return best[-1]


def score_of(pieces, ids):
    names = {k: s for s, k in pieces.score.values()}
    spelt = sum(1 for k in ids if k not in names and pieces.text[k][0] & 0xC0 != 0x80)
    return sum(names.get(k, 0.0) for k in ids) + spelt * pieces.foreign


def test_streaming_viterbi_is_optimal(small_texts):
    pieces = sentencepiece.Pieces(MODEL)
    for _, text in small_texts[:12]:
        text = text[:600].replace(" ", "▁") + "日本\U0001f600"
        viterbi, ids = sentencepiece.StreamingViterbi(pieces), []
        for k in range(0, len(text), 7):
            ids += viterbi.push(text[k : k + 7])
            assert len(viterbi.text) <= 4 * pieces.longest  # what is held is bounded
        ids += viterbi.finish()
        assert score_of(pieces, ids) == plain_viterbi(pieces, text)
        assert b"".join(pieces.text[k] for k in ids) == text.replace("▁", " ").encode()


def test_sentencepiece_agrees_with_the_library_on_words(small_texts):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    encode, seen = sentencepiece.encoder(MODEL), 0
    pieces = sentencepiece.Pieces(MODEL)
    for word in sorted({w for _, t in small_texts[:60] for w in t.split()})[:3000]:
        ids = encode(word.encode()).tolist()
        # Beside pieces of -1e9 the library's single precision loses the other scores, and its
        # way need not be the best.
        if score_of(pieces, ids) > -1e6:
            theirs = library.encode(word)
            assert ids == theirs or score_of(pieces, ids) >= score_of(pieces, theirs)
            seen += ids == theirs
    assert seen > 1000


def test_stretches_are_asked_for_once_and_put_together():
    asked = []

    def ids_of(stretches):
        asked.extend(stretches)
        sizes = np.array([len(s.split()) for s in stretches], np.int64)
        return sizes, np.array([len(w) for s in stretches for w in s.split()], "<u4").tobytes()

    def starts(data):
        return data == ord("|")

    texts = ["", "a bb|ccc", "|ccc", "", "é é|", "a bb|ccc|ccc||", ""]
    found = common.by_stretch([t.encode() for t in texts], starts, ids_of)
    assert [x.tolist() for x in found] == [[], [1, 2, 4], [4], [], [1, 1, 1], [1, 2, 4, 4, 1, 1], []]
    assert sorted(asked) == ["a bb", "|", "|ccc", "é é"]
    assert common.by_stretch([], starts, ids_of) == []


def test_search_goes_on_from_what_neighbours_share(small_texts, monkeypatch):
    pieces, searched = sentencepiece.Pieces(MODEL), []
    words = {"▁" + w for _, t in small_texts for w in t.split()} | {"▁" * 99, "日本", "日x", "x" * 40}
    expected = {w: sentencepiece.segment_ids(pieces, w) for w in words}
    plain = sentencepiece.StreamingViterbi._extend

    def counted(self, signs):
        searched.append(len(signs))
        plain(self, signs)

    monkeypatch.setattr(sentencepiece.StreamingViterbi, "_extend", counted)
    assert dict(sentencepiece.segment_many(pieces, words)) == expected
    assert sum(searched) < 0.7 * sum(map(len, words))


def test_encoders_of_texts_with_odd_signs():
    from tokenizers import Tokenizer

    parts = ["It's", "we're", "ÀÉß", "x÷y", "日本", "naïve\xa0", "<|", "a<|endoftext|>b", "\x00\x1c\x85",
             "42", "▁", "▁▁w", "W.W.", "'", "\U0001f600"]
    whites = [" ", "  ", "\n", "\t", " \n ", "\r\n", "\v\f", "\n\n"]
    rng = random.Random(3)
    texts = ["", " ", "\n", "  \n"] + [
        "".join(rng.choice(parts) + rng.choice(whites) for _ in range(rng.randrange(1, 9)))
        for _ in range(300)
    ]
    coded = [t.encode() for t in texts] + [None]
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    words = word_encoder(path)(coded)
    for text, ids in zip(texts, words):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    pieces = sentencepiece.Pieces(MODEL)
    for text, ids in zip(texts, sentencepiece.batch_encoder(MODEL)(coded)):
        signs = "▁" * pieces.prefix + text.replace(" ", "▁")
        stretches = re.findall("\n|▁*[^▁\n]+|▁+", signs) if text else []
        assert ids.tolist() == [i for s in stretches for i in sentencepiece.segment_ids(pieces, s)]
        assert sentencepiece.encoder(MODEL)(text.encode()).tolist() == ids.tolist()
    assert len(words[-1]) == 0


def test_words_that_occur_again_are_cut_into_runs_once(monkeypatch):
    path, plain, seen = tokenizer_path("word_bpe_49k.json"), tokens._RUNS, []

    class Runs:
        def findall(self, text):
            seen.append(text)
            return plain.findall(text)

    monkeypatch.setattr(tokens, "_RUNS", Runs())
    text = "Some words, again and again and again.\n"
    ids = word_encoder(path)([text.encode() * 50] * 20)
    assert len(ids) == 20 and len({tuple(x) for x in ids}) == 1 and len(ids[0]) % 50 == 0
    assert sum(map(len, seen)) < 2 * len(text)


def test_sentencepiece_round_trip(odd, no_documents, rows):
    found = sentencepiece.encode_documents(odd, MODEL)
    texts = {i: t for i, t in odd_rows()}
    for r in found.collect():
        assert r.n_ids == len(r.ids) and r.round_trip == ("▁" not in (texts[r.doc_id] or ""))
    decoded = sentencepiece.decode_documents(found, MODEL)
    expected = [(i, (t or "").replace("▁", " ")) for i, t in odd_rows()]
    assert rows(decoded) == sorted(expected, key=repr)
    assert sentencepiece.encode_documents(no_documents, MODEL).collect() == []


def test_sentencepiece_query(spark, small_texts):
    found = queries()["op2_sentencepiece"](spark, SMALL)
    assert found.filter("round_trip").count() == len(small_texts)
    # No segmentation of a whole text, searched at once, has a higher score.
    pieces, ids = sentencepiece.Pieces(MODEL), {r.doc_id: r.ids for r in found.collect()}
    assert sorted(ids) == sorted(i for i, _ in small_texts)
    for i, text in small_texts:
        signs = "▁" * pieces.prefix + text.replace(" ", "▁")
        assert np.isclose(score_of(pieces, ids[i]), plain_viterbi(pieces, signs), rtol=1e-9)


def plain_difference(rows, target, vocabulary, weight=10.0):
    split = [(i, (t or "").lower().split() if (t or "").isascii() else None) for i, t in rows]
    assert all(w is not None for _, w in split)
    counts = Counter(w for _, ws in split for w in ws)
    known = set(sorted(counts, key=lambda w: (-counts[w], w))[:vocabulary])
    models = []
    size = len(known) + 2
    for of in (lambda i: i in target, lambda i: True):
        pairs, before, single = Counter(), Counter(), Counter()
        for i, ws in split:
            if of(i):
                ws = ["<s>"] + [w if w in known else "<o>" for w in ws]
                for v, w in zip(ws, ws[1:]):
                    pairs[v, w] += 1
                    before[v] += 1
                    single[w] += 1
        total = sum(single.values()) + size - 1

        def loss(v, w, pairs=pairs, before=before, single=single, total=total):
            p = (single[w] + 1) / total
            return -np.log((pairs[v, w] + weight * p) / (before[v] + weight))

        models.append(loss)
    out = {}
    for i, ws in split:
        ws = ["<s>"] + [w if w in known else "<o>" for w in ws]
        out[i] = [
            np.mean([m(v, w) for v, w in zip(ws, ws[1:])]) if len(ws) > 1 else None for m in models
        ]
    return out


def test_cross_entropy_difference(spark, no_documents):
    rows = [(i, t) for i, t in odd_rows() if i is not None and (t or "").isascii()]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, target string")
    target = spark.createDataFrame([(8,), (9,), (9,), (None,), (99,)], "doc_id long")
    expected = plain_difference(rows, {8, 9}, 20)
    found = cross_entropy_difference(docs, target, vocabulary=20).collect()
    assert len(found) == len(rows)
    for r in found:
        mine, theirs = (r.target_loss, r.background_loss), expected[r.doc_id]
        assert (mine == (None, None)) == (theirs == [None, None])
        if theirs[0] is not None:
            assert np.allclose(mine, theirs, rtol=1e-5)
            assert np.isclose(r.difference, mine[0] - mine[1])
    assert cross_entropy_difference(no_documents, target).collect() == []
    assert cross_entropy_difference(docs, target.filter("false"), 20).count() == len(rows)


@pytest.mark.parametrize("table_words", [2, 300, 2_046])
def test_words_beyond_the_table_are_told_apart(spark, table_words):
    from .conftest import words

    rows = [(k, " ".join(words(k, 30 + k, 40 + 200 * (k % 40)))) for k in range(200)]
    rows += [(200, "rare1 w1"), (201, "rare2 w1"), (202, "w1 rare1"), (203, "rare2"), (203, "rare2")]
    assert len({w for _, t in rows for w in t.split()}) > 3_000
    docs = spark.createDataFrame([*rows, (204, None)], "doc_id long, text string").repartition(3)
    target = docs.filter("doc_id % 3 = 0").select("doc_id")
    expected = plain_difference(rows, {k for k in range(300) if k % 3 == 0}, 10**9)
    found = cross_entropy_difference(docs, target, table_words=table_words).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        mine = (r.target_loss, r.background_loss)
        if r.doc_id == 204:
            assert mine == (None, None)
        else:
            assert np.allclose(mine, expected[r.doc_id], rtol=1e-5)


def test_language_model_query(spark, small_texts):
    found = queries()["op8_lm_scoring"](spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    mean = dict(found.join(labels, "doc_id").groupBy("quality").agg(F.avg("difference")).collect())
    assert found.count() == len(small_texts) and mean[1] < mean[0]


def test_toxicity_query_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"
    found = queries()["op7_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert right > 0.97 and found.count() == 10_000


def test_identity_terms_do_not_count(spark):
    """Insults stand beside one group more often; without the penalty its name tells."""
    texts = []
    for k in range(400):
        toxic = k % 2
        group = "muslims" if (toxic and k % 20) or k % 10 == 0 else "christians"
        insult = f"idiot{k % 3}" if toxic and k % 4 else "people"
        texts.append((k, f"{group} are {insult} of town{k % 7}", toxic))
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    probe = spark.createDataFrame(
        [(1, "muslims are people of town1"), (2, "christians are people of town1"), (3, None)],
        "doc_id long, text string",
    )
    gaps = []
    for penalty in (0.0, 10.0):
        model = toxicity.train(docs.drop("toxic"), labels, penalty=penalty)
        score = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
        gaps.append(abs(score[1] - score[2]))
    assert gaps[1] < 0.25 * gaps[0] and gaps[1] < 0.1


def test_toxicity_scores_are_plain(spark, documents, small_texts):
    """The scores of a fitted model are those of its weights, added up one by one."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train(documents, labels)
    assert model.weights
    for r in toxicity.score(documents, model).collect():
        text = dict(small_texts)[r.doc_id]
        features = {f for w in text.encode().split() for f in toxicity.word_features(w)}
        odds = model.bias + sum(model.weights.get(f, 0.0) for f in features)
        assert np.isclose(r.score, 1 / (1 + np.exp(-odds)))


def test_toxicity_fit_is_a_minimum():
    """Plain descent on the whole loss, from the fitted weights or from zero, gets no lower."""
    rng = np.random.default_rng(3)
    rows = [sorted(set(rng.integers(0, 12, 5).tolist())) for _ in range(200)]
    labels = np.array([int(3 in r) ^ int(rng.random() < 0.2) for r in rows])
    pairs = [([int(a), int(b)], [1.0, -1.0]) for a, b in rng.integers(0, 12, (30, 2)) if a != b]
    weights, bias = toxicity.fit(rows, labels, pairs, 12, penalty=1.0)
    x = np.zeros((200, 12))
    for k, r in enumerate(rows):
        x[k, r] = 1.0
    d = np.zeros((len(pairs), 12))
    for k, (columns, signs) in enumerate(pairs):
        d[k, columns] = signs

    def loss(w, b):
        z = x @ w + b
        log_loss = np.mean(np.log1p(np.exp(z)) - labels * z)
        return log_loss + 0.5e-4 * w @ w + np.mean((d @ w) ** 2)

    w, b = np.zeros(12), 0.0
    for _ in range(20_000):
        error = 1 / (1 + np.exp(-(x @ w + b))) - labels
        w = w - 0.1 * (x.T @ error / 200 + 1e-4 * w + 2 * d.T @ (d @ w) / len(pairs))
        b -= 0.1 * error.mean()
    assert loss(weights, bias) < loss(w, b) + 1e-3 < loss(np.zeros(12), 0.0)


def test_toxicity_of_odd_rows(spark, odd, no_documents):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (2, 0), (7, 1), (7, 0), (None, 1), (8, None), (9, 3)],
        "doc_id long, toxic int",
    )
    model = toxicity.train(odd, labels, least=1)
    assert toxicity.score(odd, model).count() == len(odd_rows())
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() <= len(odd_rows())
    none = toxicity.train(no_documents, labels.filter("false"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(no_documents, none).collect() == []
