from slopewise.llm import decontam

ITEM = "A farmer called Jonas Miller sells 12 kg of apples to Maria for 30 dollars, then Jonas Miller buys 5 kg of pears from the market at noon."
OTHER = ITEM.replace("Jonas", "Peter").replace("Maria", "Anna").replace("12", "1,750").replace("30", "88").replace("5 kg", "9 miles")
MIXED = ITEM.replace("Jonas Miller sells", "Peter Miller sells").replace("then Jonas", "then Robert").replace("for 30 dollars", "for 12 dollars")
PLAIN = "which of the following statements about rivers and lakes in the north is true and why would that be so"
BENCH = "item_id long, text string, doc_id string"


def run(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "k", 1.0) for i, t in texts], "doc_id long, text string, item_id string, coverage double")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], BENCH)
    return sorted((str(r.doc_id), r.item_id) for r in decontam.contaminated(docs, bench).collect()), docs, bench


def test_reparameterised_questions_are_found(spark):
    filler = "nothing of interest stands in this sentence at all and it goes on. "
    texts = [
        (1, ITEM), (2, filler * 3 + OTHER + " " + filler), (3, filler * 9), (4, None), (5, ""), (6, PLAIN.upper()), (7, "x " + PLAIN + " y"),
        (8, " ".join(PLAIN.split()[:7])), (9, "\n".join(PLAIN.split())), (10, "12 13 14 15 16 17 18 19 20 21 22 23"), (None, PLAIN), (7, "x " + PLAIN + " y"), (11, filler * 2000 + PLAIN), (12, PLAIN + " " + ITEM),
    ]
    found, docs, bench = run(spark, texts, [(1, ITEM), (2, PLAIN), (2, PLAIN), (3, None), (4, ""), (5, "too short"), (6, "1 2 3 4 5 6 7 8 9 10")])
    assert found == sorted([("1", 1), ("2", 1), ("6", 2), ("7", 2), ("9", 2), ("None", 2), ("11", 2), ("12", 1), ("12", 2)])
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["10", "3", "4", "5", "8"]


def test_inconsistent_slots_do_not_count(spark):
    short = "Today Jonas gives Maria his red book and then Jonas asks Maria for it back."
    swapped = "Today Peter gives Anna his red book and then Robert asks Julia for it back."
    same = "Today Peter gives Anna his red book and then Peter asks Anna for it back."
    found, _, _ = run(spark, [(1, same), (2, swapped), (3, swapped + " " + same)], [(1, short)])
    assert found == [("1", 1), ("3", 1)]


def test_items_shorter_than_a_window_and_empty_tables(spark):
    assert run(spark, [(1, "so who wrote this famous book then"), (2, "who wrote this book")], [(1, "Who wrote this famous book?")])[0] == [("1", 1)]
    assert run(spark, [], [(1, ITEM)])[0] == []
    assert run(spark, [(1, ITEM)], [])[0] == []


def test_items_of_one_template_are_told_apart_by_their_slots(spark):
    items = [(k, f"so a shop sells {k} green boxes and later it buys {k} red boxes from a farm nearby") for k in range(1, 40)]
    items += [(90, "so a shop sells 5 green boxes and later it buys 6 red boxes from a farm nearby")]
    found, _, _ = run(spark, [(1, items[6][1]), (2, items[-1][1])], items)
    assert found == sorted([("1", k) for k in range(1, 40)] + [("1", 90)] + [("2", 90)] + [("2", k) for k in (5, 6)] + [("2", k) for k in range(1, 40) if k not in (5, 6)])


def test_one_conflict_drops_its_windows_only(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    long = " ".join([*words[:20], "12", *words[20:50], "Jonas", *words[50:60], "12", *words[60:80], "Jonas", *words[80:]])
    number, name = long.replace("12", "13", 1), long.replace("Jonas", "Peter", 1)
    sums = "so a shop sells 12 green boxes and later it buys 30 red boxes from a farm nearby"
    fruit = "so a child has 5 apples in the basket and then finds 5 pears under the old tree"
    texts = [(1, number), (2, name), (3, sums.replace("12", "7").replace("30", "7")), (4, fruit.replace("5 pears", "8 pears")), (5, "an unlike text " * 9)]
    found, docs, bench = run(spark, texts, [(1, long), (2, sums), (3, fruit)])
    assert found == [("1", 1), ("2", 1), ("3", 2), ("4", 3)]
    assert [r.doc_id for r in decontam.clean_documents(docs, bench).collect()] == [5]


def test_copies_word_for_word_of_short_and_dense_items(spark):
    items = [
        "Who directed The Lord Of The Rings The Return Of The King", "Is Mount Kenya higher than Mount Kilimanjaro", "What is 12 plus 30",
        "Compute 12 + 7 - 5 * 3 + 9", "Who wrote Hamlet?", "Paris",
    ]
    texts = [(k, f"it was asked: {t} and so on") for k, t in enumerate(items)] + [(10 + k, t) for k, t in enumerate(items)]
    texts += [(20, "What is 12 plus 31"), (21, "Is Mount Elbrus higher than Mount Blanc"), (22, "Compute 1 + 7 - 5 * 3 + 2"), (23, "Who wrote Faust?")]
    found, docs, bench = run(spark, texts, enumerate(items))
    assert found == sorted([(str(k), k) for k in range(6)] + [(str(10 + k), k) for k in range(6)])
    assert sorted(r.doc_id for r in decontam.clean_documents(docs, bench).collect()) == [20, 21, 22, 23]
