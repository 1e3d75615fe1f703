"""Leaks that stand beside other forms of the same item."""

from edge import documents
from test_scoring import QUESTION, bench, leaked

from linkspan.llm import decontamination

ITEM = "First Alice gives 5 coins to the boy and then Alice takes 5 coins from him while Alice sees 5 coins fall"


def variant(name, number, item=ITEM):
    return item.replace("Alice", name).replace("5", str(number))


def test_variants_beside_one_another_are_caught(spark):
    two = variant("Maria", 7) + ". Some other words come between them here. " + variant("Jonas", 9)
    beside = ITEM + ". " + variant("Maria", 7)
    many = ". ".join(variant(n, k) for k, n in enumerate(("Maria", "Jonas", "Peter", "Anna", "Clara"), 11))
    torn = "First Maria gives 1 coins to the boy and then Jonas takes 2 coins from him while Peter sees 3 coins fall"
    assert leaked(spark, [(1, two), (2, beside), (3, many), (4, torn), (5, torn + ". " + torn)], [ITEM]) == {(1, 0), (2, 0), (3, 0)}


def test_variants_with_a_word_put_in_are_caught(spark):
    edited = [variant(n, k).replace("and then", "and only then") for n, k in (("Maria", 7), ("Jonas", 9), ("Peter", 3))]
    assert leaked(spark, [(1, ". Other words stand here. ".join(edited))], [ITEM]) == {(1, 0)}


def test_a_pair_is_reported_once(spark):
    text = ". ".join([QUESTION, QUESTION.replace("60", "45").replace("Alice", "Maria"), QUESTION])
    got = decontamination.leaks(documents(spark, [(1, text), (1, text)]), bench(spark, [QUESTION, QUESTION])).collect()
    assert len(got) == 4 and all(r.n_matched <= r.n_windows and r.consistency >= 0.8 for r in got)


SUM = "Compute 12 + 34 * 56 - 78 / 9"


def test_copies_of_items_of_numbers_are_caught(spark):
    list_ = "Add the numbers 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 and give the sum"
    docs = [(1, f"Some words first. {SUM} and more."), (2, "Compute 11 + 34 * 56 - 78 / 9"), (3, f"Homework: {list_}."), (4, list_.replace("3 4 5 6 7 8", "9 9 9 9 9 9")), (5, "12 34 56 78 9")]
    assert leaked(spark, docs, [SUM, list_]) >= {(1, 0), (3, 1)}
    assert {(d, i) for d, i in leaked(spark, docs, [SUM, list_]) if i == 0} == {(1, 0)}


def test_copies_of_short_items_are_caught(spark):
    docs = [(1, "He asked: What is 2+2? Nobody knew."), (2, "What is 2+3?"), (3, "what is\n2+2"), (4, "What"), (5, "is 2+2 what"), (6, "is 2+2"), (6, "What")]
    assert leaked(spark, docs, ["What is 2+2?", "", "..."]) == {(1, 0), (3, 0)}


def test_plain_windows_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert leaked(spark, [(1, SUM), (2, "What is 2+2?"), (3, "Compute 1 + 2")], [SUM, "What is 2+2?"]) == {(1, 0), (2, 1)}


def test_each_value_has_one_other_both_ways(spark):
    """Two values of the item that one value of the document replaces do not fit; one slot under many windows is one slot."""
    item = "Say that 3 men dig a hole in 7 hours and then 3 men more come to help them so that after 7 hours the work of 3 men is done"
    merged = item.replace("3", "5").replace("7", "5")
    other = item.replace("3", "4").replace("7", "9")
    once = item.replace("7 hours the work", "8 hours the work")
    got = leaked(spark, [(1, merged), (2, other), (3, item), (4, once)], [item])
    assert got == {(2, 0), (3, 0), (4, 0)}
    rows = decontamination.leaks(documents(spark, [(4, once)]), bench(spark, [item])).collect()
    assert rows[0].consistency == 6 / 7  # one of seven slots, two of them units


def test_without_the_slot_check_a_torn_question_passes(spark, monkeypatch):
    torn = "First Maria gives 1 coins to the boy and then Jonas takes 2 coins from him while Peter sees 3 coins fall"
    assert leaked(spark, [(1, torn)], [ITEM]) == set()
    monkeypatch.setattr(decontamination, "CONSISTENT", 0)
    assert leaked(spark, [(1, torn)], [ITEM]) == {(1, 0)}
