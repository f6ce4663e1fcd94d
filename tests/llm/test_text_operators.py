"""Chat formatting, decontamination, token counts, page text: edge cases against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidecast.llm import bpe, chat, decontaminate, html_crf

public_tokenizers = pytest.importorskip("public_tokenizers")


def _chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_chat_reads_back_and_marks_assistant_texts(spark):
    control = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|turn|>", "<<|start|>", "a<", "<<SYS>>x<</SYS>>", "", "é<|text|>"]
    rows = [(1, 2, "assistant", "b", "x"), (1, 1, "user", "a", "x"), (1, 3, "assistant", "c", None), (2, 0, None, None, None),
            (None, 0, "user", "lost", None), (3, 0, "assistant", "", None), (4, None, "assistant", "z", None), (4, 0, "assistant", "z", None), (4, 0, "assistant", "z", None)]
    rows += [(9, k, ["user", "assistant", "<|text|>"][k // 3], t, None) for k, t in enumerate(control)]
    out = chat.format_chats(_chats(spark, rows)).withColumn("back", chat.read_chats(F.col("formatted"))).withColumn(
        "loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    want = {}
    for c, turn, role, text, _ in rows:
        want.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        turns = [x[2:] for x in sorted(want[r["conv"]])]
        assert [tuple(x) for x in r["back"]] == turns
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert [r["formatted"][s - 1:s - 1 + n].count("<|") for s, n in r["loss_spans"]] == [0] * len(r["loss_spans"])
    merged = next(r["formatted"] for r in out if r["conv"] == 1)
    assert merged == "<s><|start|>user<|text|>a<|end|><|start|>assistant<|text|>b<|turn|>c<|end|></s>"
    assert chat.format_chats(_chats(spark, [])).count() == 0


def test_long_conversations_take_work_in_proportion(spark):
    """Nothing in the plan grows an array turn by turn, and one shuffle serves the places and the gathering."""
    turns = spark.range(60_000).select(F.when(F.col("id") >= 0, 1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("x").alias("formatted"),
                                       F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    out = chat.format_chats(turns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert " aggregate(" not in plan and plan.count("Exchange hashpartitioning") == 1
    row = out.first()
    texts = [f"é{k}" for k in range(60_000) if k % 3]
    assert [row["formatted"][s - 1:s - 1 + n] for s, n in row["loss_spans"]] == texts


QUESTION = "Each morning farmer Tom carries 12 kg of ripe apples past the old mill and sells 12 of them to Tom at the gate before lunch."


def test_leaks_see_through_numbers_names_and_units(spark):
    other = QUESTION.replace("Tom", "Anna").replace("12", "35").replace("kg", "lbs")
    mixed = QUESTION.replace("sells 12", "sells 99").replace("to Tom", "to Zed")
    docs = [(1, "Intro words here. " + QUESTION + " More."), (2, other), (3, mixed), (4, QUESTION.upper()), (5, None), (6, ""), (7, "too short"),
            (8, "Nothing of the kind is said in this text about a farmer who carries apples past some other mill."), (None, QUESTION), (10, " ".join(["1 2 3 4 5 6 7 8"] * 5)), (1, "again")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, key int")
    items = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, "5 6 7 8 9 10 11 12 13"), (3, None), (4, "")], "item_id long, text string")
    out = {(r["id"], r["item_id"]): r for r in decontaminate.leaks(docs, items).collect()}
    assert {k[0] for k in out} == {1, 2, None, 4} and {k[1] for k in out} == {1}
    assert not out[1, 1]["reparameterised"] and out[2, 1]["reparameterised"]
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 5, 6, 7, 8, 10]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_one_torn_slot_takes_only_the_windows_that_change_it(spark):
    item = "the shop has 2 red apples on a shelf near the door and nobody who walks by in the early morning hours ever asks for 2 green pears from the cellar"
    docs = [(1, item.replace("2 green", "7 green")), (2, item.replace("2 red", "3 red").replace("2 green", "5 green")), (3, item.replace("2", "9"))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["id"]: (r["n_windows"], r["n_found"], r["reparameterised"]) for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: (24, 18, False), 2: (24, 14, False), 3: (24, 24, True)}


def test_short_and_number_heavy_items_are_found(spark):
    items = [(1, "What is the capital of France?"), (2, "5 + 6 = 11, 7 + 8 = 15, 9 + 1 = 10"), (3, "Photosynthesis"), (4, "3 4 5"), (5, " ?! ")]
    docs = [(1, "Quiz: What is the capital of France? Paris."), (2, "so 5 + 6 = 11, 7 + 8 = 15, 9 + 1 = 10 it is"), (3, "photosynthesis"), (4, "6 4 5 and 3 4 6"),
            (5, "5 + 6 = 11, 7 + 8 = 15, 9 + 2 = 11"), (6, "2 3 4 5"), (7, ""), (8, "The capital of France is Paris")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1), (2, 2), (3, 3), (6, 4)}


def test_names_in_runs_and_at_the_start_of_sentences_are_placeholders(spark):
    marked = lambda t: [w for w in spark.range(1).select(decontaminate.words(F.lit(t))).first()[0] if w < "0"]
    assert marked('Tom met John Mary Smith. "Anna" left') == ["\x01tom", "\x01john", "\x01mary", "\x01smith", "\x01anna"]
    items = [(1, "Last week in spring John Smith gave his old red bicycle to the kind John Smith"), (2, "Tom has 3 apples in the box. Anna has 5 pears in the bag. Who has more?")]
    docs = [(1, items[0][1].replace("John Smith", "Mary Jones")), (2, "Now: " + items[1][1].replace("Tom", "Zoe").replace("Anna", "Ben")),
            (3, items[1][1].title()), (4, items[1][1].upper()), (5, "he said tom" + items[1][1][3:]), (6, "Tom has no pears and Anna went to the box office in the rain")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 2)}


def test_values_that_become_one_and_clashing_columns(spark):
    item = "a farmer has 2 red hens in the old barn and also keeps 5 green ducks near the long river bank"
    texts = [item.replace("2", "9").replace("5", "9"), item.replace("2", "7").replace("5", "9"), item]
    docs = spark.createDataFrame([(k, t, 1, "g", 0) for k, t in enumerate(texts)] + [(8, "Yes it does", 1, "g", 0), (None, item, 1, "g", 0)],
                                 "doc_id long, text string, _id int, _gone string, near int")
    items = spark.createDataFrame([(1, item), (2, "Yes")], "item_id long, text string")
    out = {(r["id"], r["item_id"]): r for r in decontaminate.leaks(docs, items).collect()}
    # Both windows beside one of the two values, and those over both, tell of another text.
    assert set(out) == {(1, 1), (2, 1), (8, 2), (None, 1)} and out[1, 1]["n_found"] == out[2, 1]["n_found"] == out[1, 1]["n_windows"]
    assert out[8, 2]["item_words"] == 1 and out[1, 1]["item_words"] == 21
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 8]
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, items, least_words=1).collect()} == {0, None}


def test_leaks_equal_plain_windows_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: re.findall(r"\w+", t.lower())
    windows = {r["item_id"]: {tuple(w[k:k + 8]) for k in range(len(w) - 7)} for r in items.collect() for w in [plain(r["text"])]}
    want = set()
    for d in docs.collect():
        w = plain(d["text"])
        seen = {tuple(w[k:k + 8]) for k in range(len(w) - 7)}
        want |= {(d["doc_id"], i) for i, ws in windows.items() if ws and len(ws & seen) >= 0.5 * len(ws)}
    assert {(r["id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == want and want


def test_token_counts_equal_the_library(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(1)
    bits = ["a", "b", " ", "\n", "\t", "é", "'s", "'", "12", "  ", " ", "\x1c", "\x85", "<|endoftext|>", "😀", "the", " of", "!!", "aaaa", "字", "́", "²", "\r\n", "​", " \n"]
    texts = ["", " ", "a" * 3000, " a", "a "] + ["".join(rnd.choices(bits, k=rnd.randint(1, 60))) for _ in range(800)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    merges = bpe.read_merges(path)
    assert bpe.Counter(merges).count(texts) == want
    monkeypatch.setattr(bpe, "STRETCH", 9)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    assert bpe.Counter(merges).count(texts) == want
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts[:40])] + [(99, None, 0), (99, None, 0)], "doc_id long, text string, n_tokens int")
    got = docs.select("doc_id", bpe.token_counts(docs, path).alias("n")).orderBy("doc_id").collect()
    assert [r["n"] for r in got] == [*want[:40], 0, 0]
    assert docs.limit(0).select(bpe.token_counts(docs, path)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p><b>First   line<br><p>Second&nbsp;line, with <i>words</i>.</article><footer>&copy; someone</footer>"""
OTHERS = [
    ('<html><body><div class="menu"><a href=x>Home</a></div><div id="content"><h1>Title of it</h1><p>First para, long enough.</p><div class="comments"><p>Nice post, thanks.</p></div></div>'
     '<div class="sidebar"><p>Related things.</p></div><div class="cookie-notice">We use cookies.</div><form>Your mail <input></form><div class="footer">Rights reserved</div></body></html>', "Title of it\nFirst para, long enough."),
    ("<html><body><header>Site</header><main><h2>T</h2><p>Some text.</p><aside>Not this.</aside><p>More text.<section class=comments><p>I disagree.</p></section></main><footer>foot</footer>", "T\nSome text.\nMore text."),
    ("<p>Only a plain paragraph with text.</p>", "Only a plain paragraph with text."), ("", ""), (None, ""), ("<script>x</script><!-- c -->", "")]


def test_rare_training_pages_are_found_at_every_size(spark, monkeypatch):
    for name, size in (("TRAIN_PAGES", 6), ("LOOKED_AT", 24)):
        monkeypatch.setattr(html_crf, name, size)
    rows = [(k, f"<article>{k}</article>" if k % 500 == 3 else f"<p>{k}</p>") for k in range(4_000)] + [(None, None), (5, "<main>" + "x" * html_crf.TRAIN_CHARS)]
    few = html_crf.training_pages(spark.createDataFrame(rows, "page_id long, html string"))
    assert len(few) == 6 and all(h.startswith("<article>") for h in few)
    every = spark.createDataFrame([(k, f"<main >{k}</main>") for k in range(5_000)], "page_id long, html string")
    assert html_crf.training_pages(every) == html_crf.training_pages(every.repartition(9)) and len(html_crf.training_pages(every)) == 6
    assert html_crf.training_pages(every.limit(0)) == []


def test_page_text(spark):
    sample = [PAGE.replace("First", f"Number {k} of the first") for k in range(30)] + [
        r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20).collect()]
    crf = html_crf.train(sample)
    pages = spark.createDataFrame([(k, "u", h, "x") for k, (h, _) in enumerate(OTHERS)] + [(None, None, PAGE, "x"), (0, "u", OTHERS[0][0], "x")], "page_id long, url string, html string, text string")
    out = html_crf.main_text(pages, crf).collect()
    assert [r["text"] for r in out if r["id"] is not None] == [t for _, t in OTHERS] + [OTHERS[0][1]]
    assert [r["text"] for r in out if r["id"] is None] == ["A & B\nFirst line\nSecond line, with words."]
    assert html_crf.main_text(pages.limit(0), crf).count() == 0


def test_page_text_of_pages_not_trained_on(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    crf = html_crf.train_on(pages.where("page_id < 100"))
    unseen = pages.where("page_id >= 100").collect()
    for r in unseen:
        blocks = html_crf.read_blocks(r["html"])
        assert crf.decode(blocks) == [html_crf.markup_label(b) for b in blocks]
    assert html_crf.train_on(pages.limit(0)).decode(html_crf.read_blocks(PAGE))[-1] == 0


def test_turn_digest_is_that_of_the_rows(spark):
    from tidecast.llm.queries import op2_chat_format

    out = {r["conv_id"]: r for r in op2_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    for conv in {r[0] for r in rows}:
        said = "".join(f"{role}\n{text}\n" for c, _, role, text in rows if c == conv)
        assert out[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert out[-7]["n_turns"] == 2 and out[-7]["loss_chars"] == len("</s>[INST] ok [/INST]")
