import random

import pytest

from tessella.llm import subject

DOC = "doc_id long, text string, area_id int, n int"
EX = "example_id int, area_id int, lang string, text string, extra string"
TOPICS = {1: ["methane leakage", "carbon removals", "flaring volumes"], 2: ["boiler efficiency", "grid power", "steam purchased"], 3: ["river intakes", "effluent quality", "aquifer abstraction"]}
FORMS = ["Targets that concern {} state the year 2020.", "The entity describes how it monitors {} at each site.", "Guidance on {} applies to leased assets.", "What drives {} differs between regions."]
NONE = ["Figures may not add up because of rounding.", "Early application is permitted if that fact is stated.", "Headings do not affect the reading of the text.", "Terms in italics are defined in the appendix.", "An index is given on the last pages."]


def paragraph(rng, area):
    if area is None:
        s = rng.sample(NONE, 2)
        if rng.random() < 0.5:
            s.append(f"For {rng.choice(TOPICS[rng.choice([1, 2, 3])])}, see the separate chapter.")
        return " ".join(s)
    return " ".join(f.format(rng.choice(TOPICS[area])) for f in rng.sample(FORMS, 3))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    examples = [(i, a, "en", paragraph(rng, a), "") for i, a in enumerate([1, 2, 3, None] * 6)]
    docs, want = [], set()
    for i in range(500):
        areas = [rng.choice([1, 2, 3, None]) for _ in range(rng.randrange(1, 4))]
        docs.append((i, rng.choice(["\n\n", "\n", "\r\n\r\n"]).join(paragraph(rng, a) for a in areas), 0, 0))
        want |= {(i, a) for a in areas if a}
    docs += [(1000, None, 0, 0), (1001, "", 0, 0), (1002, " \n ", 0, 0), (1003, docs[0][1], 0, 0), (1004, "\n\n".join([paragraph(rng, 1)] * 2000), 0, 0)]
    want |= {(1003, a) for d, a in list(want) if d == 0} | {(1004, 1)}
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(examples, EX), want


def test_areas_of_held_out_documents(world):
    docs, examples, want = world
    got = [tuple(r) for r in subject.find_areas(docs, examples).collect()]
    assert len(got) == len(set(got))
    hit = len(set(got) & want)
    assert hit >= 0.97 * len(want) and hit >= 0.97 * len(got)
    assert not {d for d, _ in got} & {1000, 1001, 1002} and (1004, 1) in got


def test_composition_counts_documents_and_units(spark, world):
    docs, examples, _ = world
    areas = spark.createDataFrame([(1, "climate"), (2, "energy"), (3, "water")], "area_id int, area_name string")
    rows = {r.area_name: (r.n_documents, r.n_units) for r in subject.composition(docs, examples, areas).collect()}
    assert set(rows) == {"climate", "energy", "water", "none"} and rows["climate"][1] > 2000


def test_units():
    text = "One.\n| a | b |\n|---|---|\n| 1 | 2 |\nQ: How?\nA: So.\n\n{\"x\": 1}"
    assert subject.units(text) == ["One.", "| a | b |\n|---|---|\n| 1 | 2 |", "Q: How?\nA: So.", '{"x": 1}']
    assert subject.units("stops in the\r\n\r\n middle of it.\nNext.") == ["stops in the middle of it.", "Next."]
    assert subject.units(None) == [] == subject.units(" \n")


def test_empty_tables(spark, world):
    docs, examples, _ = world
    assert subject.find_areas(docs.limit(0), examples).collect() == []
    assert subject.find_areas(docs.limit(5), examples.limit(0)).collect() == []


def test_every_unit_of_every_document_counts_in_the_fit(spark, world):
    """Words that only a few of many documents hold, three each, are learnt and spread."""
    _, examples, _ = world
    rare = ["".join(random.Random(i).choices("bcdfgklmnprstvz", k=9)) for i in range(40)]
    rows = [(i, f"Filler line number {i} of no import.", 0, 0) for i in range(12_000)]
    rows += [(20_000 + 10 * i + j, f"Targets that concern methane leakage and {w} for {'xyz'[j]} state the year 2020. Guidance on carbon removals applies to leased assets.", 0, 0) for i, w in enumerate(rare) for j in range(3)]
    model = subject.fit_on(spark.createDataFrame(rows, DOC).repartition(4), examples).model
    assert [w for w in rare if w not in model.slots] == []
    at = [model.slots[w] for w in rare]
    assert (model.evidence[0, at].argmax(axis=1) == 1 + model.areas.index(1)).all() and (model.evidence[0, at].max(axis=1) > 0).all()


def test_leaves_are_labelled_and_decide(spark, world):
    docs, examples, want = world
    leaves = subject.leaf_report(docs, examples).where("is_subject and n_units > 0").collect()
    for area, names in TOPICS.items():
        marks = " ".join(r.terms for r in leaves if r.area_id == area)
        assert any(w in marks for name in names for w in name.split())
    corpus = subject.fit_on(docs, examples)
    corpus.model.mixture[:] = 0.0
    assert corpus.subjects().where("size(subjects) > 0").count() == 0


def test_a_mixed_leaf_gives_several_subjects():
    m = subject.Model(["en"], {}, None, None, None, subject.np.array([[0.1, 0.5, 0.4], [0.8, 0.1, 0.1]]), [7, 9], [[], []])
    assert m.subjects() == [[7, 9], []]


def test_the_grid_is_the_same_for_any_number_of_cells(world, monkeypatch):
    docs, examples, _ = world
    gathered, grids = subject._gathered, []
    monkeypatch.setattr(subject, "_gathered", lambda *a: grids.append(a[3]) or gathered(*a))
    monkeypatch.setattr(subject, "CELLS", 1, raising=False)
    subject.fit_on(docs, examples)
    assert grids == [subject.GRID]
