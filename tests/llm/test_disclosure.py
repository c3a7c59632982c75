from siltstone.llm import disclosure as D

LEXICON = [("ada", True, False), ("bo", True, False), ("mira", True, False), ("moreaux", False, True), ("lindgard", False, True)]


def by_form(text):
    return [(k, text[a:b]) for k, a, b in sorted(D.typed_mentions(text), key=lambda m: m[1])]


def test_forms():
    assert by_form("Mail a.b+x@mail.foo-bar.example. or c [dot] d [at] foo [dot] org, e(at)f.example; DEPLOY@relay is none, @a/b-core@1.2.3 neither") == [
        ("email", "a.b+x@mail.foo-bar.example"), ("email", "c [dot] d [at] foo [dot] org"), ("email", "e(at)f.example")]
    phones = ["+44 1632 960700", "+33 1 99 00 62 13", "01.99.00.05.76", "030/23125-467", "365-555-0171", "(934) 555-0188", "+1 542-555-0149", "+18895550128", "+49 30 23125 326", "893.555.0122", "01632 960 961", "0491 570 157"]
    assert by_form("; ".join(f"call {p} now" for p in phones)) == [("phone", p) for p in phones]
    assert by_form("contact=a@b.example;tel:389.555.0164;scope=3") == [("email", "a@b.example"), ("phone", "389.555.0164")]
    assert by_form("issued on social\nsecurity number 947 01 6816 or driving\n> licence QX-6276-13246") == [("id_number", "947 01 6816"), ("id_number", "QX-6276-13246")]
    assert by_form("Range 319-332-338, part 48-447-22, 27417357261 rows on 192.0.2.192:8080 at 2024-10-15 08:29:08, build 5.5.2+26365123456") == []
    ids = {"passport no. ": "ZZ9812677", "driving licence ": "QX-3761-00817", "DNI ": "00008788-G", "Steuer-ID ": "00 789 630 214", "SSN: ": "666312615", "SSN ": "666-80-1409", "NINO: ": "QQ549875C", "NI number ": "QQ 68 69 59 C", "ID card ": "AX144 8769", "PESEL ": "78991346442", "social security number ": "919 02 7723"}
    for label, number in ids.items():
        assert by_form(f"issued on {label}{number}, signed") == [("id_number", number)]
    streets = ["176 Ropewalk Avenue", "42 Foundry St.", "P.O. Box 186", "110 boulevard Saint-Corbin", "45, avenue du Vieux Moulin", "201 bis rue des Orfraies", "C/ Alfareros 104", "Avenida del Molino 159", "Krähenstraße 94", "Lindenhofweg 167a", "Alte Mühlgasse 115", "Am Torfstich 112"]
    for street in streets:
        assert by_form(f"sent to {street}, 00410 Orthausen.") == [("address", street)]
    assert by_form("235 episode summaries on Foundry Road, box 93, row 12") == []


def test_mentions(spark):
    names = spark.createDataFrame(LEXICON, "term string, given boolean, family boolean")
    texts = {
        "a": "Owner: Ada Moreaux <x@y.example> and LINDGARD, BO; bo von lindgard met Dr. Moreaux\nand Mira K. Moreaux-Lindgard. Mira agreed, Lindgard too, 12 ms. Ada Lindgard left.",
        "b": "", "c": None, "d": "word " * 100_000 + "Ada\n> Moreaux", "e": "ada.moreaux@y.example only",
    }
    rows = [("episodes", k, "1", v, "clash") for k, v in texts.items()] + [("episodes", "a", "0", "Bo Moreaux in an old delivery", "x"), ("episodes", "a", "1", texts["a"], "y")]
    frame = spark.createDataFrame(rows, "source_table string, record_id string, version string, text string, kind string").select("source_table", "record_id", "version", "text")
    found = sorted((r["record_id"], r["start_at"], texts[r["record_id"]][r["start_at"] : r["end_at"]]) for r in D.mentions(frame, names).collect() if r["kind"] == "person")
    assert [(i, t) for i, _, t in found] == [
        ("a", "Ada Moreaux"), ("a", "LINDGARD, BO"), ("a", "bo von lindgard"), ("a", "Dr. Moreaux"), ("a", "Mira K. Moreaux-Lindgard"), ("a", "Ada Lindgard"), ("d", "Ada\n> Moreaux")]
    assert D.mentions(frame.limit(0), names).count() == 0


def test_lexicon_scores(spark):
    people = [("ada", "moreaux"), ("ada", "lindgard"), ("bo", "moreaux"), ("bo", "lindgard"), ("records", "desk")] * 3
    text = " ".join(f"{g}.{f}@y.example" for g, f in people) + " the records desk keeps the records of the desk " * 40
    counts = D.term_counts(spark.createDataFrame([(text,), (None,), ("",)], "text string"))
    found = {r["term"]: (r["given"], r["family"]) for r in D.lexicon(counts).collect()}
    assert found == {"ada": (True, False), "bo": (True, False), "moreaux": (False, True), "lindgard": (False, True)} or set(found) == {"ada", "moreaux", "lindgard"}
    assert "records" not in found and "desk" not in found


def test_on_tables(spark, sf):
    rows = D.p4_found(spark, sf).collect()
    assert len(rows) == len(set(map(tuple, rows))) and {r["kind"] for r in rows} == {"email", "phone", "id_number", "address", "person"}
    hidden = [r["text"] for r in D.p4_text(spark, sf).collect() if r["text"]]
    assert not any("@" in t and D.typed_mentions(t) and D.typed_mentions(t)[0][0] == "email" for t in hidden)


def test_names_of_copied_texts_and_with_one_partner(spark, tmp_path):
    plain = " the crawler rotates archived ranks and readers inspect the calendar rows at noon"
    people = [("ada", "moreaux"), ("ada", "lindgard"), ("bo", "moreaux"), ("bo", "lindgard"), ("ilse", "quandt")]
    texts = [f"{g}.{f}@y.example asked{plain} note {i}" for i, (g, f) in enumerate(people * 4)]
    texts += [f"records.desk@y.example replied, the desk keeps records {i}" for i in range(8)]
    copied = f"Bo Lindgard noted{plain}"
    chunks = [(f"c{i}", t, "1") for i, t in enumerate([*texts, *[copied] * 200, "Then Ilse Quandt left the records desk."])]
    spark.createDataFrame(chunks, "id string, body string, updated_at string").write.parquet(f"{tmp_path}/asset_chunks.parquet")
    spark.createDataFrame([], "id string, summary string, updated_at string").write.parquet(f"{tmp_path}/episodes.parquet")
    spark.createDataFrame([], "export_id string, text_body string, sender string, exported_at_epoch long").write.parquet(f"{tmp_path}/parsed_email.parquet")
    found = {(r["record_id"], r["start_at"]) for r in D.p4_found(spark, str(tmp_path)).collect() if r["kind"] == "person"}
    assert found == {(f"c{i}", 0) for i in range(28, 228)} | {("c228", 5)}


def test_terms_that_give_an_entity_away_are_generalised(spark):
    """A planted by-word stands beside one person only, common words beside everybody."""
    people = ["Ilse Quandt", "Bo Lindgard", "Ada Moreaux", "Mira Lindgard"]
    texts = [f"{people[i % 4]} inspected the archive rows at noon, case {i}" for i in range(40)]
    texts += [f"the harpist of Ostvale, Ilse Quandt, inspected rows, case {i}" for i in range(6)]
    texts += ["the archive of rows at noon near Ostvale needs the harpist", None, ""]
    spans = lambda t: [("person", t.index(p), t.index(p) + len(p)) for p in people if p in t] if t else None
    rows = [("episodes", f"e{i}", t, spans(t)) for i, t in enumerate(texts)] + [("episodes", "again", texts[41], spans(texts[41]))]
    records = spark.createDataFrame(rows, "source_table string, record_id string, text string, spans array<struct<kind:string,start_at:int,end_at:int>>")
    terms = D.disclosing_terms(records, least_bits=1.0)
    assert {r["term"]: (r["kind"], r["seen"], r["together"]) for r in terms.collect()} == {"harpist": ("person", 7, 6), "ostvale": ("person", 7, 6)}
    clean = {r["record_id"]: r["text"] for r in D.sanitised(records, terms).collect()}
    assert clean["e40"] == "the [TERM] of [TERM], [PERSON], inspected rows, case 0" and clean["e0"] == "[PERSON] inspected the archive rows at noon, case 0"
    assert clean["e46"] == "the archive of rows at noon near [TERM] needs the [TERM]" and clean["e47"] is None and clean["e48"] == ""
    assert D.disclosing_terms(records.limit(0)).count() == 0


def test_filter_is_sized_by_its_terms():
    from siltstone.llm import bloom

    assert bloom.size_for(0) == bloom.LEAST_BITS and bloom.size_for(1_000_000) == 1 << 24 and bloom.size_for(10**9) == bloom.MOST_BITS


def test_filter_lets_few_others_pass(spark):
    from siltstone.llm import bloom

    known = spark.range(100_000).selectExpr("concat('w', id) AS term")
    member = bloom.Member(bloom.build(known))
    assert all(member(f"w{i}") for i in range(0, 100_000, 997)) and sum(member(f"x{i}") for i in range(20_000)) < 200
