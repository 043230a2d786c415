import datetime as dt

from tallyloom.operators import logos, steps

D = dt.date


def test_wordings_and_their_order(spark):
    said = {
        "Prelungire termenului de adoptare tacită": ("deadline_extended", None), "Clasat conform art. 63": ("archived", None), "Respins în ședința comună pentru=3": ("rejected", "joint"),
        "Dezbatere la Camera Deputaților": ("plenary_debate", "deputies"), "Solicitare punct de vedere de la Guvern": ("government_view_requested", None),
        "Trimis pentru aviz la: (termen: 1.2.2024)": ("committee_opinion_requested", None), "Trimis pentru raport suplimentar la Consiliul X": ("sent_to_committee", None),
        "Comisia juridică transmite avizul cu nr. 4-favorabil cu amendamente": ("committee_opinion_received", None), "Consiliul X depune raportul": ("committee_report_received", None),
        "Consiliul X transmite avizul": ("opinion_received", None), "Aprobarea procedurii de urgență": ("urgency_decided", None), "Se cere procedura de urgență": ("urgency_requested", None),
        "Prezentare în Biroul permanent; procedura de urgență": ("registered", None), "  înaintat la  Senat": ("sent_to_senate", None), "": ("other", None), None: ("other", None),
    }
    rows = steps.typed(spark.createDataFrame([(t,) for t in said], "text string")).collect()
    assert {r.text: (r.type, r.chamber) for r in rows} == said
    assert {r.text: r.verdict for r in rows}["Comisia juridică transmite avizul cu nr. 4-favorabil cu amendamente"] == "favorable_with_amendments"
    assert [r.deadline_on for r in rows if r.deadline_on] == ["2024-02-01"]


def test_fates(spark):
    made = [
        (1, D(2024, 1, 1), 1, "promulgation", None, "Promulgat prin Decret nr. 5/2024"), (1, D(2024, 1, 3), 2, "promulgation", None, "Devine Legea nr. 9/2024"),
        (2, D(2024, 1, 1), 1, "rejected", "deputies", "x"), (2, D(2024, 1, 1), 2, "other", None, None),
        (3, D(2024, 1, 1), 1, "rejected", "senate", "x"), (4, D(2024, 1, 1), 1, "procedure_ended", None, "Încetarea procedurii, înaintare la Senat"),
        (5, D(2024, 1, 1), 1, "procedure_ended", None, "Încetarea"), (6, D(2024, 1, 1), 1, "procedure_ended", None, "Încetarea"), (6, D(2024, 1, 2), 2, "other", None, "x"),
    ]
    rows = spark.createDataFrame(made, "bill_id int, occurred_on date, ord int, type string, chamber string, text string")
    bills = spark.createDataFrame([(i, {7: "Retras", 8: "A devenit Legea nr.238/12.12.2025 publicată în M.O. nr.1171/17.12.2025"}.get(i), "senate") for i in range(1, 10)], "bill_id int, stage string, decision_chamber string")
    got = {r.bill_id: tuple(r)[1:] for r in steps.fates(rows, bills).collect()}
    none = (None, None, None, None)
    assert got == {
        1: ("promulgated", D(2024, 1, 3), "9", 2024, "5", None), 2: ("in_progress", None, *none), 3: ("rejected", D(2024, 1, 1), *none), 4: ("in_progress", None, *none),
        5: ("ended", D(2024, 1, 1), *none), 6: ("in_progress", None, *none), 7: ("withdrawn", None, *none), 8: ("promulgated", D(2025, 12, 12), "238", 2025, None, "1171"), 9: ("in_progress", None, *none),
    }


def test_report_readings(spark):
    pages = [(1, 1, "Text obișnuit " * 20 + "\ncu amendamente admise"), (1, 2, "x\nANEXA nr. 1 - Amendamente   respinse\n" + "cuvânt " * 20), (1, 3, "AMENDAMENTE ADMISE\nAmendamente respinse " + "da " * 30), (2, 1, None), (3, 1, "b1c " * 30 + "bun " * 30)]
    got = {r.report_id: tuple(r)[1:] for r in steps.report_readings(spark.createDataFrame(pages, "report_id int, page int, text string")).collect()}
    assert got == {1: (3, 0.0, "clean", 3, 2), 2: (1, 100.0, "none", None, None), 3: (1, 50.0, "poor", None, None)}


def test_logos(spark):
    seen = [(2, "h1", "a")] * 9 + [(2, "h1", "b")] + [(1, "h2", "b")] * 3 + [(2, "h3", "c"), (1, "h4", "d"), (2, "h5", None), (2, "h6", "a"), (2, "h6", "b")]
    got = {r.party_id: (r.legislature_id, r.content_hash, r.confidence) for r in logos.picked(spark.createDataFrame(seen, "legislature_id int, content_hash string, party_id string")).collect()}
    assert got == {"a": (2, "h1", "confident"), "b": (1, "h2", "confident"), "c": (2, "h3", "weak")}
