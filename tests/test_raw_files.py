"""From small raw CSV files to the wide order table and the risk features."""
import pytest

from bazaarlens.operators import marts as M
from bazaarlens.sources import RAW_SCHEMAS, RawTables, read_raw

FILES = {
    "orders": ["o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 12:00:00,2018-01-03 12:00:00,2018-01-10 12:00:00,2018-01-08 00:00:00",
               "o2,c2,delivered,2018-02-01 10:00:00,2018-02-01 11:30:00,2018-02-02 11:30:00,2018-02-04 11:30:00,2018-02-20 00:00:00",
               "o3,c3,shipped,2018-02-03 09:00:00,,,,2018-02-25 00:00:00", "o4,c4,delivered,not a time,,,,2018-02-25 00:00:00"],
    "order_items": ["o1,1,p1,s1,2018-01-02 00:00:00,10.50,1.25", "o1,2,p2,s2,2018-01-05 00:00:00,20.00,2.00", "o2,1,p1,s1,2018-02-03 00:00:00,10.50,1.00"],
    "order_payments": ["o1,1,credit_card,3,30.00", "o1,2,voucher,1,3.75", "o2,1,boleto,1,11.50"],
    "order_reviews": ['r1,o1,5,,"good, at\nfirst",2018-01-11 00:00:00,2018-01-11 10:00:00', "r2,o1,1,,,2018-01-12 00:00:00,2018-01-12 10:00:00",
                      "r3,o2,4,,,2018-02-05 00:00:00,2018-02-05 10:00:00", "r4,o2,bad,,,2018-02-06 00:00:00,2018-02-06 10:00:00"],
    "customers": ["c1,u1,01000,sao paulo,SP", "c2,u1,01000,sao paulo,SP", "c3,u2,20000,rio,RJ", "c4,u3,20000,rio,RJ"],
    "sellers": ["s1,20000,rio,RJ", "s2,01000,sao paulo,SP"],
    "products": ["p1,beleza,10,100,2,500,10,10,10", "p2,,10,200,1,300,20,10,5"],
    "geolocation": ["01000,-23.0,-46.0,sao paulo,SP", "01000,-24.0,-47.0,sao paulo,SP", "20000,-22.9,-43.2,rio,RJ"],
    "category_translation": ["beleza,beauty"],
}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, rows in FILES.items():
        header = ",".join(x.split()[0] for x in RAW_SCHEMAS[name].split(", "))
        (folder / f"{name}.csv").write_text("\n".join([header, *rows]) + "\n")
    return read_raw(spark, str(folder))


def test_bad_rows_carry_their_file_and_text(raw):
    bad = raw["order_reviews"].where("_bad IS NOT NULL").collect()
    assert len(bad) == 1 and "r4,o2,bad" in bad[0]._bad and bad[0]._file.endswith("order_reviews.csv")


def test_wide_orders(raw):
    t = RawTables(raw)
    got = {r.order_id: r for r in t.orders_detail(goods=True).collect()}
    assert set(got) == {"o1", "o2", "o3", "o4"}
    o1, o2, o3 = got["o1"], got["o2"], got["o3"]
    assert (o1.is_delivered, o1.is_late, o1.item_cnt, float(o1.order_amount), o1.review_score, o1.is_seller_late) == (1, 1, 2, 33.75, 1, 1)
    assert (o1.approve_hours, o1.carrier_hours, o1.lastmile_hours) == (2.0, 48.0, 168.0)
    assert (o1.seller_cnt, o1.product_cnt, o1.pay_type_cnt, o1.has_credit_card, o1.max_installments) == (2, 2, 2, 1, 3)
    assert (o1.photos_qty, o1.weight_g, o1.volume_cm3) == (2, 800, 2000) and 150 < o1.avg_distance_km < 250
    assert (o2.is_late, o2.review_score, o2.customer_state, o2.has_credit_card) == (0, 4, "SP", 0)
    assert (o3.is_delivered, o3.is_late, o3.item_cnt, o3.review_score, o3.seller_cnt) == (0, None, 0, None, 0)
    assert got["o4"].purchase_ts is None
    assert {(r.product_id, r.category_en) for r in t.order_items().collect()} == {("p1", "beauty"), ("p2", None)}


def test_features_from_raw_files(raw):
    t = RawTables(raw)
    got = {r.order_id: r for r in M.order_features(t.orders_detail(t.orders_wide(state=False), goods=True), t.order_sellers(), t.order_items()).collect()}
    assert set(got) == {"o1", "o2"} and got["o1"].is_bad == 1 and got["o2"].is_bad == 0
    assert got["o2"].seller_hist_cnt == 1 and got["o2"].seller_hist_bad_rate == 1 and got["o2"].cat_hist_cnt == 1
