"""Repeated passages, near-duplicate texts and components against brute force."""

import random

import numpy as np
import pytest
from helpers import documents, near_duplicate_classes, smallest_reachable
from pyspark import cloudpickle

from docfields.llm import chains, common, graph, setsketch

VOCABULARY = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [" ".join(prose(rng, rng.randint(1, 300))) for _ in range(40)]
    base = prose(rng, 200)
    out += [" ".join(edited(rng, base, rng.randint(0, 6))) for _ in range(60)]  # a group whose members lie on both sides of the border
    chain = prose(rng, 150)
    for _ in range(10):  # each like the one before, the ends far apart
        chain = edited(rng, chain, 2)
        out.append(" ".join(chain))
    out += [out[3]] * 30 + ["", " \t\n", "one", "One", "a b c d e", "a b c d e f g", "a b c d e f", "x " * 5000]
    out += [" ".join(prose(rng, 20000))] * 2
    rng.shuffle(out)
    return dict(enumerate(out))


def test_near_duplicates_match_brute_force(spark, texts):
    want, sizes = near_duplicate_classes(texts)
    got = setsketch.near_duplicates(documents(spark, texts.items())).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_near_duplicates_in_many_blocks(spark, texts, monkeypatch):
    """Buckets cut into blocks of a few rows give the same classes."""
    want, _ = near_duplicate_classes(texts)
    whole = setsketch.candidates
    monkeypatch.setattr(setsketch, "candidates", lambda members, forest: whole(members, forest, 7))
    got = setsketch.near_duplicates(documents(spark, texts.items())).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_pipeline_drops_near_copies_from_four_fifths_on(spark):
    """Similarities from 0.80 up to below 0.85 are links of the pipeline's stage, but none of op3."""
    import corpus_pipeline

    rng = random.Random(11)
    out, want = {}, set()
    for i in range(0, 60, 2):
        base = prose(rng, 204)  # 200 shingles; k changed end words leave 200 - k of them shared
        k = (14, 17, 20, 22, 23, 26)[i // 2 % 6]
        out[i], out[i + 1] = " ".join(base), " ".join(base[:-k] + [f"n{i}x{j}" for j in range(k)])
        want |= {i} | ({i + 1} if 100 * (200 - k) < 80 * (200 + k) else set())
    docs = documents(spark, out.items())
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert got == want and 30 < len(want) < 60
    kept = {r.doc_id for r in setsketch.near_duplicates(docs).filter("kept").collect()}
    assert kept > got


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert got == sorted(
        [(None, 2, None, True), (1, 0, 1, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (4, 0, 4, True)], key=repr
    )
    assert setsketch.near_duplicates(documents(spark, [])).count() == 0


def test_joint_likelihood_finds_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85):
        all_ = setsketch.mixed(rng.integers(1, 2**63, 2000).astype(np.uint64))
        common = int(2000 * share)
        half = (2000 - common) // 2
        a, b = all_[: common + half], np.concatenate([all_[:common], all_[common + half :]])
        x, y = setsketch.registers(np.unique(a)), setsketch.registers(np.unique(b))
        assert (np.maximum(x, y) == setsketch.registers(np.unique(all_))).all()  # mergeable
        more, less = np.array([(x > y).sum()]), np.array([(x < y).sum()])
        est = setsketch.likeliest(more, less, 256 - more - less, np.array([len(a)]), np.array([len(b)]))
        assert abs(est[0] - share) < 0.12


def windows(texts, n=50):
    seen = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    return [(d, i) for places in seen.values() if len({p[0] for p in places}) > 1 for d, i in places]


def test_every_shared_run_of_fifty_words_is_found(spark):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (50, 55, 80, 300)]
    texts = {}
    for d in range(60):
        parts = [prose(rng, rng.randint(5, 200))]
        if d % 2:
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 60))]
        if d % 7 == 1:
            parts += [edited(rng, passages[3], 4), prose(rng, 30)]
        texts[d] = " ".join(sum(parts, []))
    texts |= {100: "same line here " * 400, 101: "same line here " * 500, 102: "", 103: texts[1], 104: "short license line of eleven words that many texts repeat often"}
    texts[105] = texts[104]
    got = chains.repeated_passages(documents(spark, texts.items())).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50 and r.mate_id != r.doc_id
    # what 101 has more of its line repeats 101 itself
    need = [(d, i) for d, i in windows(texts) if d != 101 or i < 1100]
    assert need and all(any(s <= i and i + 50 <= e for s, e in spans.get(d, ())) for d, i in need)
    clean = {d for d in range(0, 60, 2) if d % 7 != 1} | {102, 104, 105}
    assert not clean & set(spans)


def covered(spark, texts):
    """Windows of fifty shared words that no passage covers."""
    spans = {}
    for r in chains.repeated_passages(documents(spark, texts.items())).collect():
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    need = windows(texts)
    assert need
    return [(d, i) for d, i in need if not any(s <= i and i + 50 <= e for s, e in spans.get(d, ()))]


def test_shared_runs_whose_seeds_lie_in_other_documents(spark):
    """Every 8-word and 40-word part of the passage also stands in lower and higher documents, the 50 words in two only."""
    rng = random.Random(21)
    run = prose(rng, 50)
    texts = {50: " ".join(prose(rng, 30) + run + prose(rng, 30)), 51: " ".join(prose(rng, 70) + run + prose(rng, 9))}
    for i in range(11):
        for d in (i, 100 + i):
            texts[d] = " ".join(prose(rng, 20 + d) + run[i : i + 40] + prose(rng, 25))
    for i in range(0, 43):
        for d in (200 + i, i - 1000):
            texts[d] = " ".join(prose(rng, 20) + run[i : i + 8] + prose(rng, 25))
    assert not covered(spark, texts)


def test_each_copy_inside_a_document_is_covered(spark):
    rng = random.Random(22)
    passage, other = prose(rng, 60), prose(rng, 55)
    twice = prose(rng, 20) + passage + prose(rng, 20) + passage + prose(rng, 5)
    texts = {1: " ".join(twice), 2: " ".join(prose(rng, 40) + passage), 3: " ".join(prose(rng, 10) + passage + prose(rng, 10))}
    texts |= {4: "same line here " * 400, 5: "same line here " * 500}
    texts |= {6: " ".join(other[20:35] + prose(rng, 30) + other), 7: " ".join(prose(rng, 30) + other), 8: " ".join((other + prose(rng, 3)) * 100)}
    assert not covered(spark, texts)


def test_edited_copy_inside_a_document_is_covered(spark):
    """The second copy is edited, too, and has no partner of its own."""
    rng = random.Random(23)
    passage = prose(rng, 100)
    second = [f"e{i}" if i % 25 == 12 else w for i, w in enumerate(passage)]
    texts = [(1, " ".join(prose(rng, 20) + passage + prose(rng, 20) + second + prose(rng, 20))), (2, " ".join(passage + prose(rng, 10)))]
    got = {(r.doc_id, r.start_word, r.end_word) for r in chains.repeated_passages(documents(spark, texts)).collect()}
    assert got == {(1, 20, 120), (1, 140, 240), (2, 0, 100)}


def test_passages_with_an_edit_in_twelve_words(spark):
    rng = random.Random(24)
    texts = []
    for i in range(0, 100, 2):
        passage = prose(rng, 100)
        changed = [f"e{i}x{j}" if j % 12 == 11 else w for j, w in enumerate(passage)]
        texts += [(i, " ".join(passage)), (i + 1, " ".join(changed))]
    found = {r.doc_id for r in chains.repeated_passages(documents(spark, texts)).collect()}
    assert len(found) >= 98


def test_edited_passage_whose_seeds_all_lie_in_other_documents(spark):
    """Lower and higher documents hold 30 words of the passage each, so they are the first and the last of all its seeds; two documents
    between them share its 120 words, edited, and a third holds it twice."""
    rng = random.Random(41)
    passage = prose(rng, 120)
    rows = [(d, " ".join(prose(rng, 20) + passage[i : i + 30] + prose(rng, 20))) for i in range(0, 91, 6) for d in (i - 1000, 1000 + i)]
    copies = [[f"e{d}x{i}" if i % 20 == 5 * d else w for i, w in enumerate(passage)] for d in range(4)]
    rows += [(500 + d, " ".join(prose(rng, 40) + copies[d] + prose(rng, 10))) for d in (1, 2)]
    rows.append((503, " ".join(copies[0] + prose(rng, 60) + copies[3] + prose(rng, 5))))
    got = {(r.doc_id, r.start_word, r.end_word) for r in chains.repeated_passages(documents(spark, rows)).collect()}
    assert {(d, s // 30, e // 30) for d, s, e in got} == {(501, 1, 5), (502, 1, 5), (503, 0, 4), (503, 6, 10)} and len(got) == 4


def test_passage_with_edits_is_one_span(spark):
    rng = random.Random(2)
    passage = prose(rng, 120)
    changed = passage[:30] + ["new"] + passage[31:70] + passage[72:]
    a, b = prose(rng, 40) + passage + prose(rng, 40), prose(rng, 10) + changed + prose(rng, 50)
    docs = documents(spark, [(1, " ".join(a)), (2, "\n".join(b))])
    found = chains.repeated_passages(docs)
    assert {r.doc_id: (r.start_word, r.end_word, r.mate_id) for r in found.collect()} == {1: (40, 160, 2), 2: (10, 128, 1)}
    texts = {r.doc_id: r for r in chains.passage_texts(docs, found).collect()}
    assert texts[1].text == " ".join(passage) and texts[2].text == "\n".join(changed)
    assert texts[2].start_char == len("\n".join(b[:10])) + 1 and texts[2].end_char - texts[2].start_char == len(texts[2].text)


def test_short_parts_of_several_documents_are_no_passage(spark):
    """30 words of each of three documents in a row: no two documents share more than 30 words. With 60 words of one of them there is a
    passage, and it ends there."""
    rng = random.Random(8)
    others = {d: prose(rng, 120) for d in (10, 11, 12)}
    rows = [(d, " ".join(w)) for d, w in others.items()]
    parts = [w[40:70] for w in others.values()]
    assert chains.repeated_passages(documents(spark, [(1, " ".join(sum(parts, []))), *rows])).count() == 0
    longer = others[10][40:70] + others[11][30:90] + others[12][40:70]
    got = {(r.doc_id, r.start_word, r.end_word, r.mate_id) for r in chains.repeated_passages(documents(spark, [(1, " ".join(longer)), *rows])).collect()}
    assert got == {(1, 30, 90, 11), (11, 30, 90, 1)}


def test_heavy_seeds_take_another_way_to_the_same_passages(spark, monkeypatch):
    """A line that stands in most documents and opens a shared passage in some: the same rows whether its seeds meet in one task or not."""
    rng = random.Random(9)
    line, passage = prose(rng, 30), prose(rng, 60)
    rows = [(i, " ".join(prose(rng, 40) + line + (passage if i % 20 == 0 else []) + prose(rng, 10))) for i in range(200)]
    docs = documents(spark, rows)
    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(chains.repeated_passages(docs))
    monkeypatch.setattr(chains, "SAMPLE", 1)
    monkeypatch.setattr(chains, "HEAVY", 0.004)
    monkeypatch.setattr(chains, "SENT_DOCS", 3)
    assert len(chains.heavy_seeds(chains.texts_of(docs))) > 3
    assert order(chains.repeated_passages(docs)) == want and {r[0] for r in want} == set(range(0, 200, 20))


def test_passages_of_awkward_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(None, long), (1, None), (2, ""), (3, long), (3, long)]
    assert chains.repeated_passages(documents(spark, rows)).count() == 0
    assert chains.repeated_passages(documents(spark, [])).count() == 0


def test_chaining_takes_the_best_rising_matches():
    p, q = np.array([0, 8, 16, 24, 32]), np.array([100, 8, 108, 116, 24])
    assert chains.chained(p, q)[0] == [0, 2, 3]


def test_components_of_paths_stars_and_strangers(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    want = smallest_reachable({i for a, b in links if a != b for i in (a, b)}, [(a, b) for a, b in links if a != b])
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for i in got} and set(got) == set(want)


def test_texts_hashed_together_give_what_each_gives_alone(monkeypatch):
    """Seeds, stretches and pieces of a batch are those of its texts one by one, wherever the batch is cut."""
    rng = random.Random(31)
    texts = [None, "", " \t\n", "one", " One\x0btwo\x1cthree é ", "x " * 90, "x y " * 70] + [" ".join(rng.choice("abcde") for _ in range(n)) for n in range(110)]
    texts += [" ".join(prose(rng, n)) for n in (50, 51, 300)]
    h, bounds = common.word_hashes(texts)
    plain = [common.words(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in plain]
    assert len(set(zip(sum(plain, []), h.tolist()))) == len(set(sum(plain, []))) == len(set(h.tolist()))

    def rows(ids, texts):
        seeds, pieces = (work({"doc_id": ids, "text": texts}) for work in (chains._seed_rows, chains._piece_rows))
        return sorted(zip(*(np.asarray(seeds[c]).tolist() for c in seeds))), sorted(zip(*pieces.values()))

    together = rows(list(range(len(texts))), texts)
    alone = [rows([i], [t]) for i, t in enumerate(texts)]
    assert together == tuple(sorted(sum((r[k] for r in alone), [])) for k in (0, 1)) and together[0]
    assert h.tolist() == common.Hashes().of(sum(plain, [])).tolist()
    assert len(cloudpickle.dumps(chains._seed_rows)) < 50_000  # no tables are sent with the code
    small = common.WordHashes()
    small.CHUNK, small.PLACES = 5, 3  # words take one another's place
    monkeypatch.setattr(chains, "word_hashes", small)
    monkeypatch.setattr(chains, "PART", 40)
    assert rows(list(range(len(texts))), texts) == together
