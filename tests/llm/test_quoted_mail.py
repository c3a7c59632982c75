from siltstone.llm import quoted_mail as M

SENDER = '"Moreau, Ada" <ada.moreau@example.com>'


def fresh(text=None, html=None, sender=SENDER):
    return [t.strip() for _, t in M.new_lines(text, html, sender)]


def test_reply_styles():
    assert fresh("Hi Bo,\n\nnew text\n\nRegards,\nAda\n\nOn Mon, Apr 1, 2024 at 00:51, Bo Lee <b@example.com> wrote:\n> old\n>> older\n") == ["Hi Bo,", "new text"]
    assert fresh("On Mon, Apr 1, 2024 at 00:51 Bo Lee\n<b@example.com> wrote:\n> one\n\nanswer one\n\n> two\nanswer two\n") == ["answer one", "answer two"]
    assert fresh("Am 07.04.2024 um 13:13 schrieb Bo <b@example.com>:\n    alt\n\n    noch alt\n\nneu\n") == ["neu"]
    assert fresh("Bo Lee writes:\n| old\n| > older\n\nnew\n") == ["new"]
    assert fresh("new\r\n\r\n________________________________\r\nVon: Bo <b@example.com>\r\nGesendet: 1.1.2024\r\nAn: x\r\nBetreff: y\r\n\r\nalt\r\n") == ["new"]
    assert fresh("new\n\nBegin forwarded message:\n\nFrom: a\nDate: b\nSubject: c\n\nold") == ["new"]


def test_traps_stay():
    for text in (
        "On Mon we wrote: keep the groups. I still think so.",
        "This is what the console printed:\n>>> kb.status()\n'late, 5 rows'",
        "The header in the report reads\nFrom: a to b\nSubject: c\nand that is wrong.",
        "one\n----\nSummary -- two",
        "The disclaimer about confidential rows has to move to page 3.",
    ):
        assert fresh(text) == text.split("\n")
    assert fresh(f"Hello,\n\n{'x ' * 100_000}")[0] == "Hello,"


def test_signatures_and_banners():
    assert fresh("[EXTERNAL] Treat links and attachments with care.\n\ntext\n\nAda Moreau\nArchivist\n+1 555 0100\n\nThis message and any attachments are confidential and intended only for\nthe addressee.") == ["text"]
    assert fresh("text\n\nSent from my phone\n") == ["text"]
    assert fresh("text\n\n* * *\nAda Moreau\n") == ["text"]
    assert fresh("text\nViele Grüße\nAda\n") == ["text"]


def test_html():
    html = "<html><head><style>p{}</style><title>t</title></head><body><p>Hi&nbsp;Bo,</p><p>&nbsp;</p>new<br>more<div><blockquote><div>On Mon wrote:</div>old<br>older</blockquote></div><div>answer</div></body></html>"
    assert M.new_lines(None, html, SENDER) == [(1, "Hi Bo,"), (2, "new"), (3, "more"), (7, "answer")]
    assert M.new_lines("  \n", html, None)[0] == (1, "Hi Bo,")


def test_table(spark):
    schema = "export_id string, sender string, text_body string, html_body string, exported_at_epoch long, new_lines int"
    rows = [("a", SENDER, "old delivery", None, 1, 0), ("a", SENDER, "new delivery", None, 2, 0), ("b", None, None, None, None, 0), ("c", None, "", " ", 1, 0), (None, None, "x", None, 1, 0)]
    frame = spark.createDataFrame(rows, schema)
    found = {r["export_id"]: [x["line"] for x in r["new_lines"]] for r in M.authored(frame).collect()}
    assert found == {"a": ["new delivery"], "b": [], "c": []}
    assert M.authored(frame.limit(0)).count() == 0


def test_notices_over_several_lines():
    notice = "This message and any attachments are confidential and intended only for\nthe addressee. If you received it in error, delete it and notify the\nsender."
    html = "".join(f"<div>{line}</div>\n" for line in ["text", "Regards,", "Ada", *notice.split("\n")])
    assert fresh(None, html) == ["text"]
    assert fresh(f"text\n\n{notice}\n\nmore text") == ["text", "more text"]
    assert fresh("CAUTION: This e-mail came from outside the organisation. Do not open\nlinks unless you know the sender.\ntext") == ["text"]


def test_long_notices_and_deep_quotation():
    from siltstone.llm.quoted_mail import new_lines

    notice = "This message is confidential and intended for the named reader\n" + "\n".join(f"and for clause {i} of the terms" for i in range(20)) + "\nas agreed."
    assert [t for _, t in new_lines(f"The crawler is up again.\n\n{notice}", None)] == ["The crawler is up again."]
    assert [t for _, t in new_lines("Fine with me.\n" + ">" * 2000 + " old words", None)] == ["Fine with me."]
    assert new_lines("\n".join(["----"] * 2000 + ["Fine with me."]), None)[-1][1] == "Fine with me."


def test_long_and_deep_mails_take_time_in_proportion():
    import time

    begun = time.perf_counter()
    for line in ("We met at noon and agreed on the plan.", "> older words", "---", "On 2024-01-01 someone", "> a\n\nb\n"):
        assert isinstance(M.new_lines("\n".join(["Hello."] + [line] * 16_000), None, "A B <a.b@x.example>"), list)
    assert M.new_lines("mine\n" + ">" * 10_000 + " x", None, None) == [(1, "mine")]
    assert time.perf_counter() - begun < 30  # minutes where the work grows with the square
