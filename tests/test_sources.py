import json
import zipfile

import pytest

from lotwright.sources import cards, connectors, paging, records, sheets


def test_registry():
    r = connectors.Registry()
    r.register("a", lambda: connectors.Connector("a", lambda p, c: connectors.Page([])))
    assert r.names() == ["a"] and r.create("a").name == "a"
    with pytest.raises(ValueError):
        r.register("a", lambda: None)
    with pytest.raises(KeyError):
        r.create("b")
    assert connectors.source_parameters({"low": 5.0, "x": 1, "kinds": [1, 2], "none": None}, {"low": "priceMin", "kinds": "cat"}) == ({"priceMin": 5, "cat": "1,2"}, ["x"])
    more = connectors.has_more
    assert more({"total": 45}, 1, 20, 20) and more({"page": {"totalElements": "45"}}, 2, 20, 20) and not more({"total": 45}, 3, 20, 5)
    assert not more([], 1, 20, 3) and more([], 1, 3, 3) and not more({"last": True, "total": 9}, 1, 1, 1) and more({"hasNext": 1, "total": 1}, 1, 1, 1)
    assert connectors.items_of({"data": {"lots": [{"a": 1}, 2]}}) == [{"a": 1}] and connectors.items_of({"content": [], "items": [{}]}) == [] and connectors.items_of(None) == []
    assert connectors.count_of({"totalPages": "x", "page": {"pages": 3}}, connectors.PAGES_KEYS) == 3


def test_listing_parameters():
    made, left, warnings = records.listing_parameters({"page": 3, "page_size": 500, "subject_rf": "Ярославская область", "category_code": "7", "fias": "у реки", "price_min": 1000.0, "price_max": 99.5, "is_msp": True, "odd": 1, "type_transaction": " SALE "}, {"Ярославская область": "76"})
    assert (made["page"], made["size"], made["dynSubjRF"], made["catCode"], made["priceMin"], made["priceMax"], made["isMsp"], made["typeTransaction"]) == ("2", "100", "76", "8,9,10,11,12", "1000", "99.5", "true", "sale")
    assert left == {"fias": "у реки", "odd": 1} and len(warnings) == 3
    made, left, warnings = records.listing_parameters({"fias": "8c5f1e0a-1b2c-4d3e-9f00-aabbccddeeff", "lot_status": None})
    assert made["fias"].startswith("8c5f") and made["lotStatus"] == "PUBLISHED,APPLICATIONS_SUBMISSION" and made["page"] == "0" and not left and not warnings


def test_runs():
    assert records.filters_locally("Ярославль", {"text": "x"}) and records.filters_locally("склад", {}) and not records.filters_locally("склад", {"text": "склад"}) and not records.filters_locally(" ", {})
    whole, one = records.run_specs(), records.run_specs("76", "Ярославская область")
    assert [s for s, _, _ in whole] == ["listing", "search", "catalogue"] and all(r is None for *_, r in whole)
    assert one[0][1]["subject_rf"] == "76" and one[2][1]["region_feature"] == "Ярославская область" and {r for *_, r in one} == {"76"}


def test_json_pages(spark, tmp_path):
    lot = lambda i, **k: {"id": i, "lotName": "Земельный участок 55:36:000000:123", "categoryCode": "2", "priceMin": 1250000, "lotStatus": "APPLICATIONS_SUBMISSION", **k}
    (tmp_path / "0.json").write_text(json.dumps({"content": [lot("a"), lot("a"), lot(None)], "totalElements": 4}), encoding="utf-8")
    (tmp_path / "1.json").write_text(json.dumps({"content": [lot("a"), lot("b", lotStatus="SUCCEED")]}), encoding="utf-8")
    (tmp_path / "2.json").write_text("broken")
    connectors.register(spark)
    pages = spark.read.format("json_pages").option("path", str(tmp_path)).option("pages", "3").load()
    assert pages.where("error IS NOT NULL").count() == 1
    rows = {r.external_id: r for r in connectors.normalise(pages, "reg").collect()}
    assert set(rows) == {"reg:a", "reg:b"}
    a = rows["reg:a"]
    assert (a.category, a.cadastral_number, a.start_price, a.auction_status) == ("land", "55:36:000000:123", 1250000.0, "active")
    assert pages.where("page = 1").count() == 2 and pages.where("status = 'SUCCEED'").count() == 1
    report = paging.crawl_report(pages.where("error IS NULL"), "ident", "page", 6).first()
    assert (report.pages, report.n_rows, report.n_ids, report.without_id, report.repeated, report.unexplained) == (2, 5, 2, 1, 2, 1)
    assert paging.crawl(pages, "ident", "page", "position", 1).count() == 1


def test_cards():
    page = """<div class=lot_container><div class=lot data-id=12345><p class=lot_title><a href=/lot/1>Склад</a></p><div class=lot_prices>
    <span class=current_price><span>10 000 000 руб.</span></span></div><img data-src=/a.png></div><div class=lot><a href="/lot/77/">x</a></div><div class=lot>none</div></div>"""
    got = cards.lot_cards(page)
    assert [c["ident"] for c in got] == ["12345", "77"]
    assert got[0]["price_text"] == "10 000 000 руб." and got[0]["images"] == ["/a.png"]
    assert cards.definitions("<dl><div><dt>Адрес</dt><dd>Рязань, <b>ул. 1</b></dd></div></dl>") == {"Адрес": "Рязань, ул. 1"}
    assert cards.decode("Дом".encode("cp1251")) == "Дом" and cards.decode("Дом".encode()) == "Дом"


def test_saved_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>Дом</p>".encode("cp1251"))
    assert cards.saved_pages(spark, str(tmp_path)).first().html == "<p>Дом</p>"


def test_sheets(spark, tmp_path):
    rows = [["banner"], ["Номер извещения", "Номер лота", "Предмет торгов", "Описание лота", "Начальная цена", "Размер задатка", "ИНН", "ИНН"], ["21000000000000000001", "1", "Склад", "кад. 55:36:000000:123", "1250000", "1000", "x", "y"], ["21000000000000000001", "1", "Склад", "", "1", "1", "", ""]]
    xml = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", xml)
    assert sheets.sheet_rows((tmp_path / "a.xlsx").read_bytes())[0]["ИНН"] == "y"
    got = sheets.normalise(sheets.read(spark, str(tmp_path)), "reg").collect()
    assert len(got) == 1 and got[0].external_id == "reg:21000000000000000001_1" and got[0].start_price in (1250000.0, 1.0)


def test_pages_by_number_go_on_from_a_cursor():
    from lotwright.sources import connectors

    answers = {1: {"content": [{"id": 1}, {"id": 2}], "totalElements": 5}, 2: {"content": [{"id": 3}, {"id": 4}], "totalElements": 5}, 3: {"content": [{"id": 5}], "totalElements": 5}}
    asked = []

    def fetch(parameters, page):
        asked.append((parameters, page))
        return answers.get(page, {"content": []})

    source = connectors.numbered("x", fetch, {"region": "subj"}, 2)
    got = list(connectors.every_page(source, {"region": "76", "odd": 1}))
    assert [c for c, _ in got] == [None, "2", "3"] and [r["id"] for _, p in got for r in p.rows] == [1, 2, 3, 4, 5] and got[0][1].total == 5
    assert asked[0] == ({"subj": "76"}, 1)
    assert [r["id"] for _, p in connectors.every_page(source, {}, "3") for r in p.rows] == [5]


def test_capabilities(spark):
    from lotwright.sources import connectors

    registry = connectors.Registry()
    registry.register("b", lambda: connectors.numbered("b", lambda p, n: [], {"region": "subj"}, 50))
    registry.register("a", lambda: connectors.numbered("a", lambda p, n: []))
    rows = connectors.capabilities(spark, registry).collect()
    assert [(r.source, r.page_size, r.filters, r.parameters) for r in rows] == [("a", 20, [], {}), ("b", 50, ["region"], {"region": "subj"})]


def test_items_of_saved_pages(spark, tmp_path):
    from lotwright.sources import connectors

    said = ['{"number": 0, "content": [{"id": 1, "lotStatus": "A"}, 7, {"id": ""}], "total": 9}', '{"page": {"number": 1}, "data": {"items": [{"id": "x"}]}}', '[{"id": 5}]', "broken {", '{"number": 4, "content": []}', '{"content": [], "items": [{"id": 8}]}']
    for n, text in enumerate(said):
        (tmp_path / f"{n}.json").write_text(text)
    pages = connectors.saved_pages(spark, str(tmp_path))
    got = sorted(((r.file[-6], r.page, r.position, r.ident, r.status, r.error) for r in connectors.page_items(pages).collect()), key=str)
    assert got == sorted([("0", 0, 0, "1", "A", None), ("0", 0, 1, None, None, None), ("1", 1, 0, "x", None, None), ("2", None, 0, "5", None, None), ("3", None, None, None, None, "no JSON")], key=str)
    h = connectors.health(pages).first()
    assert (h.pages, h.failed, h.empty, h["items"], h.ids, h.total, h.missing, h.status) == (6, 1, 2, 4, 3, 9, 6, "degraded")


def test_a_resumed_stream_gives_each_page_once(spark, tmp_path):
    from lotwright.sources import connectors

    def run():
        rows = connectors.page_items(connectors.saved_pages(spark, str(tmp_path / "in"), stream=True, per_trigger=2)).select("ident")
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.ident for r in spark.read.schema("ident string").parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in").mkdir()
    for n in range(5):
        (tmp_path / "in" / f"{n}.json").write_text(f'[{{"id": {n}}}]')
    assert run() == list("01234")
    (tmp_path / "in" / "9.json").write_text('[{"id": 9}]')
    assert run() == list("012349")
    assert run() == list("012349")


def test_pages_found_on_pages(spark):
    from lotwright.sources import frontier

    rnd = __import__("random").Random(3)
    names = [f"p{i}" for i in range(60)]
    rows = [(rnd.choice(names[:45]), [rnd.choice(names) for _ in range(rnd.randint(0, 2))] + [None] * (i % 5 == 0), rnd.choice([None, None, None, "timeout", "404"])) for i in range(70)] + [(None, ["p1"], None)]
    rows += [(f"c{i}", [f"c{i + 1}"], None) for i in range(15)] + [("p0", ["c0", "f1"], None), ("f1", ["p1"], "404"), ("f1", [], "timeout")]
    got = {r.address: (r.depth, r.status, r.cause) for r in frontier.reached(spark.createDataFrame(rows, "address string, links array<string>, cause string"), spark.createDataFrame([("p0",), ("p0",), (None,), ("nowhere",)], "address string")).collect()}
    depth, open_ = {"p0": 0, "nowhere": 0}, ["p0", "nowhere"]
    while open_:
        a = open_.pop(0)
        for address, links, cause in rows:
            if address == a and cause is None:
                for x in links:
                    if x and x not in depth:
                        depth[x] = depth[a] + 1
                        open_.append(x)
    want = {}
    for a, n in depth.items():
        causes = [c for b, _, c in rows if b == a]
        failed = bool(causes) and all(causes)
        want[a] = (n, "failed" if failed else "read" if causes else "unknown", min(causes) if failed else None)
    assert got == want and max(depth.values()) >= 15 and {w[1] for w in want.values()} == {"failed", "read", "unknown"}
