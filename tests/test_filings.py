import json

from barloom.sources import filings


def fact(start, end, val, fy, fp, filed):
    return {"start": start, "end": end, "val": val, "fy": fy, "fp": fp, "form": "10-Q", "filed": filed}


def test_quarters_from_facts(spark):
    rows = [
        fact("2023-01-01", "2023-03-31", 1.0, 2023, "Q1", "2023-05-01"),
        fact("2023-01-01", "2023-03-31", 9.0, 2024, "Q1", "2024-05-01"),
        fact("2023-04-01", "2023-06-30", 2.0, 2023, "Q2", "2023-08-01"),
        fact("2023-07-01", "2023-09-30", 3.0, 2023, "Q3", "2023-11-01"),
        fact("2023-01-01", "2023-06-30", 3.0, 2023, "Q2", "2023-08-01"),
        fact("2023-01-01", "2023-12-31", 10.0, 2023, "FY", "2024-02-01"),
    ]
    text = json.dumps({"facts": {"us-gaap": {"EarningsPerShareDiluted": {"units": {"USD/shares": rows}}}}})
    got = filings.eps_facts(spark.createDataFrame([("A", text), ("B", None), ("C", "{}")], "symbol string, json string")).collect()
    assert {(r.symbol, r.fy, r.fp, r.eps) for r in got} == {("A", 2023, "Q1", 1.0), ("A", 2023, "Q2", 2.0), ("A", 2023, "Q3", 3.0), ("A", 2023, "Q4", 4.0)}


def test_announcements(spark):
    text = json.dumps({"filings": {"recent": {"form": ["8-K", "8-K", "10-Q"], "filingDate": ["2024-01-02", "2024-02-03", "2024-03-04"], "items": ["2.02,9.01", "5.02", "2.02"]}}})
    assert [str(r.announce_date) for r in filings.announcements(spark.createDataFrame([("A", text)], "symbol string, json string")).collect()] == ["2024-01-02"]


def test_owners_times_transactions(spark):
    owner = "<reportingOwner><reportingOwnerId><rptOwnerCik>{}</rptOwnerCik></reportingOwnerId></reportingOwner>"
    txn = "<nonDerivativeTransaction><transactionDate><value>2024-01-0{}</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{}</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"
    xml = f"<ownershipDocument><issuer><issuerTradingSymbol> abc</issuerTradingSymbol></issuer>{owner.format('01')}{owner.format('02')}<nonDerivativeTable>{txn.format(1, 10)}{txn.format(2, 20)}</nonDerivativeTable></ownershipDocument>"
    got = filings.insider_transactions(spark.createDataFrame([("x", xml), ("y", None)], "accession string, xml string")).collect()
    assert len(got) == 4 and {(r.symbol, r.seq, r.shares, r.price, r.code) for r in got} == {("ABC", 0, 10.0, 2.5, "P"), ("ABC", 1, 20.0, 2.5, "P")}


def test_factor_lines(spark):
    lines = ["made by hand", "", ",Mkt-RF,SMB,HML,RF", "20240102,   0.50,  -0.10, -99.99,   0.020", "Copyright 2024"]
    (r,) = filings.daily_factors(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert str(r.date) == "2024-01-02" and abs(r.mkt_rf - 0.005) < 1e-12 and r.hml is None and abs(r.rf - 0.0002) < 1e-12


def test_levels_and_pairs(spark):
    rows = [(1, "a", "buy 1,250.5 stop 1200 on 2024-01-05 in 2024, 5% http://x/99"), (2, "a", "again 1250.5 and 1200"), (3, "b", "1200"), (4, "a", None)]
    d = filings.level_numbers(spark.createDataFrame(rows, "id long, source string, text string"))
    assert {r.id: r.levels for r in d.collect()} == {1: [1200.0, 1250.5], 2: [1200.0, 1250.5], 3: [1200.0], 4: []}
    assert [(r.a, r.b, r.shared, r.score) for r in filings.similar_pairs(d).collect()] == [(1, 2, 2, 1.0)]
