import random
import textwrap

import pytest

from tessella.llm import scans

SCHEMA = "seg_uid long, doc_id string, section_title string, content string, line_no int, kind string"
# words of the made-up text; pairs that differ in one letter are meant, as are forms of one word
WORDS = """the entity shall disclose consumption of water for each region and explain any change since base year targets that concern plans state
method measurement third-party reviewer sampled records on near-miss frequency guidance applies to leased as well owned assets information emissions
energy governance biodiversity electricity hazardous recycling committee remuneration insurance collateral material long-term report reports reported
segment segments policy board boards risk rises loan loans farm form site side cost most staff training hours hourly injury rate rates waste landfill
methane carbon price pricing supply chain vendor vendors audit audits community grievance channel privacy breach customer product safety recall label""".split()
# misreadings that no list names
SPOIL = [("t", "l"), ("i", "l"), ("e", "o"), ("g", "q"), ("o", "0"), ("m", "rn"), ("d", "cl"), ("s", "z"), ("a", "@")]


class Corpus:
    """Contents of several documents with headers, footers, page numbers, broken and misread words, and what is where."""

    def __init__(self, seed, contents=160):
        rng = random.Random(seed)
        weights = [1 / (1 + i) ** 0.6 for i in range(len(WORDS))]
        self.rows, self.want = [], {"furniture": set(), "hyphen": set(), "misread": set()}
        heads = {"A": ("Annual Sustainability Report 2023", "Global Mining Group | {}"), "B": ("Northern Utilities plc", "page {}"), "C": ("{} Quarterly Statement of the Group", "- {} -")}
        for uid in range(contents):
            doc = rng.choice("ABC")
            head, foot = heads[doc]
            text = " ".join(rng.choice(["The ", "Each ", "No "]) + " ".join(rng.choices(WORDS, weights, k=rng.randint(8, 16))) + "." for _ in range(14))
            out, page = [], rng.randint(1, 40)
            for k, line in enumerate(textwrap.wrap(text, rng.randint(55, 80), break_long_words=False, break_on_hyphens=False)):
                tokens = line.split(" ")
                if len(tokens) > 2 and rng.random() < 0.06:
                    i = rng.randrange(len(tokens) - 1)
                    w = tokens[i]
                    ops = [(a, b) for a, b in SPOIL if a in w[1:]]
                    if len(w) > 5 and w.isalpha() and ops:
                        a, b = rng.choice(ops)
                        at = w.index(a, 1)
                        tokens[i] = w[:at] + b + w[at + 1 :]
                        self.want["misread"].add((uid, len(out)))
                out.append(" ".join(tokens))
                if k % 9 == 8:
                    for form in (foot, head):
                        self.want["furniture"].add((uid, len(out)))
                        out.append(form.format(page))
                    page += 1
            junk = {i for u, i in self.want["furniture"] if u == uid}
            for i in range(len(out) - 1):
                nxt = i + 1
                while nxt in junk:
                    nxt += 1
                first = out[nxt].split(" ")[0] if nxt < len(out) else ""
                if i not in junk and nxt < len(out) and len(first) > 6 and first.isalpha() and first.islower() and rng.random() < 0.4 and (uid, i) not in self.want["misread"] and (uid, nxt) not in self.want["misread"]:
                    k = rng.randint(3, len(first) - 3)
                    out[i] += " " + first[:k] + rng.choice(scans.MARKS)
                    out[nxt] = first[k:] + out[nxt][len(first) :]
                    self.want["hyphen"].add((uid, i))
            self.rows.append((uid, doc, "Scope", "\n".join(out), 0, "x"))


@pytest.fixture(scope="module")
def corpus():
    return Corpus(3)


@pytest.fixture(scope="module")
def found(spark, corpus):
    extra = [(9000, "A", "Scope", None, 0, ""), (9001, "A", None, "", 0, ""), (9002, None, None, " \n ", 0, ""), (9003, "A", "Scope", "Annual Sustainability Report 2023", 0, ""), (9004, None, None, "The policy\n\n(policy) 2020", 0, "")]
    return [tuple(r) for r in scans.find_noise(spark.createDataFrame(corpus.rows + extra, SCHEMA)).collect()]


@pytest.mark.parametrize(("kind", "least"), [("furniture", 0.97), ("hyphen", 0.97), ("misread", 0.9)])
def test_recall_and_precision_on_forms_of_no_list(found, corpus, kind, least):
    got = {(u, i) for u, i, k in found if k == kind and u < 9000}
    both = len(got & corpus.want[kind])
    assert both >= least * len(corpus.want[kind]) and both >= least * len(got)


def test_odd_contents_have_no_cases_and_no_case_comes_twice(found):
    assert not [r for r in found if r[0] >= 9000] and len(found) == len(set(found))


def test_the_editor_decides(spark, corpus, monkeypatch):
    """With the scores of both perceptrons for words made constant, misreadings are no longer told from words."""
    monkeypatch.setattr(scans.Editor, "features", lambda self, w, n, c, m: ["bias"])
    monkeypatch.setattr(scans.Editor, "lonely", lambda self, w, n: ["bias"])
    got = {(r.seg_uid, r.line_no) for r in scans.find_noise(spark.createDataFrame(corpus.rows, SCHEMA)).where("kind = 'misread'").collect()}
    both = len(got & corpus.want["misread"])
    assert both < 0.5 * len(corpus.want["misread"]) or both < 0.5 * len(got)


def test_words_that_differ_in_one_place_are_found_like_by_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abc-", k=rng.randint(3, 6))): rng.randint(1, 9) for _ in range(80)}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r.word, r.printed) for r in scans.near_words(counts, counts).collect()}
    want = set()
    for w, n in words.items():
        for c, m in words.items():
            if m > n and m >= scans.LEAST_PRINTED and c[0].isalpha() and c[-1].isalpha():
                _, a, b = scans.difference(w, c)
                near = len(a) <= 2 and len(b) <= 2 and len(a) + len(b) <= 3
                if near:
                    want.add((w, c))
    assert got == want


def test_repair(spark, corpus):
    extra = [
        (9000, "A", "Scope", "The entity shall disclose water consump-\nGlobal Mining Group | 7\nAnnual Sustainability Report 2023\ntion for each reqion.\n\nTargets that concern long-\nterm plans.", 0, ""),
        (9001, None, None, None, 0, ""), (9002, None, None, " ", 0, ""),
    ]
    got = {r.seg_uid: r.text for r in scans.repair(spark.createDataFrame(corpus.rows + extra, SCHEMA)).where("seg_uid >= 9000").collect()}
    assert got == {9000: "The entity shall disclose water consumption for each region.\n\nTargets that concern long-term plans.", 9001: None, 9002: " "}


def test_empty_table(spark):
    assert scans.find_noise(spark.createDataFrame([], SCHEMA)).collect() == [] and scans.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_core_and_difference():
    assert scans.core("“(Re(ords),”") == "re(ords" or scans.core("(restated),") == "restated"
    assert scans.difference("concem", "concern") == (5, "m", "rn") and scans.difference("water", "water") == (5, "", "")
