import pytest
from pyspark.sql import functions as F

from larder import params
from larder.operators import afe, cleaning, wealth
from larder.operators.cleaning import clean_consumption


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


class TestDiary:
    def test_units(self, rows):
        df = rows("unit int, quantity double", (1, 2.0), (2, 2.0), (4, 2.0), (7, 2.0), (8, 2.0), (9, 2.0), (None, 2.0), (2, None))
        assert [r.quantity for r in cleaning.to_grams(df).collect()] == [2.0, 2000.0, 2000.0, 110.0, 110.0, 2.0, 2.0, None]

    def test_exclusion_keeps_missing_codes(self, rows):
        df = rows("item_code int", (122101,), (0,), (5,), (None,))
        assert got(cleaning.exclude_items(df)) == [(5,), (None,)]

    def test_daily_average_of_missing_is_zero(self, rows):
        df = rows("interview_id string, item_code int, quantity double", ("a", 1, 14.0), ("a", 1, 14.0), ("a", None, None))
        assert got(cleaning.daily_average(df)) == [("a", 1, 2.0), ("a", None, 0.0)]

    def test_edible_portion_where_known(self, rows):
        df = rows("item_code int, quantity_g double", (1, 10.0), (2, 10.0), (3, 10.0), (None, 10.0))
        portions = rows("item_code int, edible_portion double", (1, 0.5), (2, None), (None, 0.1))
        assert {r.item_code: r.quantity_g for r in cleaning.edible(df, portions).collect()} == {1: 5.0, 2: 10.0, 3: 10.0, None: 1.0}

    def test_per_afe_and_range(self, rows):
        df = rows("interview_id string, item_code int, quantity_g double", ("a", 1, 10.0), ("a", 2, 0.0), ("b", 1, 10.0), ("c", 1, 10.0), ("a", 3, 10000.0), ("a", 4, 10000.1))
        hh = rows("hhid string, afe double, interview_id string", ("A", 2.0, "a"), ("B", 0.0, "b"))
        scaled = cleaning.range_filter(cleaning.per_afe(df, hh))
        assert got(scaled.select("hhid", "item_code", "quantity_g")) == [("A", 1, 5.0), ("A", 3, 5000.0)]

    def test_single_value_has_no_cutpoint(self, rows):
        df = rows("item_code int, quantity_g double", (1, 10.0), (2, 10.0), (2, 1000.0))
        cut = {r.item_code: r.cutpoint for r in cleaning.log_cutpoint(df).collect()}
        assert cut[1] is None
        assert cut[2] == pytest.approx(2 + 3 * 2**0.5)
        kept = cleaning.null_outliers(df, cleaning.log_cutpoint(df))
        assert (1, 10.0) in got(kept)

    def test_negative_quantity_has_no_logarithm(self, rows):
        df = rows("item_code int, quantity_g double", (1, -5.0), (1, 10.0), (1, 1000.0))
        assert cleaning.log_cutpoint(df, k=0).first().cutpoint == pytest.approx(2)

    def test_outliers_and_median(self, rows):
        df = rows("hhid string, interview_id string, item_code int, quantity_g double",
                  *[(f"h{i}", f"i{i}", 1, float(v)) for i, v in enumerate([1, 2, 3, 10, 9000])], ("h9", "i9", None, 4.0))
        blanked = cleaning.null_outliers(df, cleaning.log_cutpoint(df, k=1))
        assert [r.hhid for r in blanked.filter("quantity_g is null").collect()] == ["h4"]
        filled = {r.hhid: r.quantity_g for r in cleaning.impute_median(blanked).collect()}
        assert filled["h4"] == 2.5
        assert filled["h9"] == 4.0

    def test_no_known_value_stays_missing(self, rows):
        df = rows("hhid string, interview_id string, item_code int, quantity_g double", ("a", "a", 1, None), ("b", "b", 2, 1.0))
        assert {r.item_code: r.quantity_g for r in cleaning.impute_median(df).collect()} == {1: None, 2: 1.0}

    def test_whole_job(self, rows):
        diary = rows("interview_id string, item_code int, unit int, quantity double",
                     ("a", 1, 2, 1.4), ("a", 122101, 1, 5.0), ("b", 1, 1, 140.0), ("z", 1, 1, 140.0))
        portions = rows("item_code int, edible_portion double", (1, 0.5))
        hh = rows("hhid string, afe double, interview_id string", ("A", 2.0, "a"), ("B", 1.0, "b"))
        out = clean_consumption(diary, portions, hh, "ZZZ", "s")
        assert {(r.hhid, r.item_code): (round(r.quantity_g, 9), round(r.quantity_100g, 9)) for r in out.collect()} == {
            ("A", 1): (50.0, 0.5), ("B", 1): (5.0, 0.05)}
        assert out.columns == ["iso3", "survey", "hhid", "item_code", "quantity_g", "quantity_100g"]


SCHEMA = ("hhid string, interview_id string, roster_id int, sex string, age double, year_birth double, month_birth double, "
          "year int, month int, adm1 string, res string, survey_wgt double")


def person(i, sex, age, yb=None, mb=None, hh="h"):
    return (hh, "i", i, sex, float(age) if age is not None else None, yb, mb, 2018, 6, "R", "Urban", 2.0)


class TestRoster:
    def test_split_date(self, rows):
        out = afe.split_yyyymm(rows("date string", ("20180612",), ("2018",), ("abcdef",), (None,)))
        assert [(r.year, r.month) for r in out.collect()] == [(2018, 6), (2018, None), (None, None), (None, None)]

    def test_clean_birth(self, rows):
        df = rows(SCHEMA, person(1, "Male", 1, 2019.0, 3.0), person(2, "Male", 1, 2018.0, 7.0), person(3, "Male", 1, 2018.0, 6.0),
                  person(4, "Male", 1, 2000.0, 13.0), person(5, "Male", 1, None, 5.0), person(6, "Male", 1, None, 7.0))
        out = {r.roster_id: (r.year_birth, r.month_birth) for r in afe.clean_birth(df).collect()}
        # 1 and 6: the year is unknown, so a later month cannot be ruled out and is blanked; 5 is earlier in any year.
        assert out == {1: (None, 3.0), 2: (2018.0, None), 3: (2018.0, 6.0), 4: (2000.0, None), 5: (None, 5.0), 6: (None, None)}

    def test_groups(self, rows):
        df = rows(SCHEMA, person(1, "Male", 1, 2017.0, 1.0), person(2, "Male", 2, 2016.0, 5.0), person(3, "Male", 2, 2016.0, 6.0),
                  person(4, "Male", 1, 2017.0, None), person(5, "Female", 2, None, None), person(6, "Female", 40), person(7, "Male", None))
        groups = {r.roster_id: r.grp for r in afe.with_person_afe(df).collect()}
        assert groups == {1: "under2", 2: "child", 3: "under2", 4: None, 5: "child", 6: "adult", 7: None}
        u2 = afe.under2(df)
        assert [r.age_months for r in u2.orderBy("roster_id").collect()] == [17.0, 24.0]
        assert sorted(r.roster_id for r in afe.children(df, u2).collect()) == [2, 5]
        unassigned = afe.unassigned_people(df).first()
        assert (unassigned.no_group, unassigned.no_need) == (2, 0)

    def test_both_forms_agree(self, rows):
        people = [person(i, s, a, 2018.0 - a, float(1 + i % 12), hh=f"h{i % 5}")
                  for i, (s, a) in enumerate((s, a) for s in ("Male", "Female") for a in range(0, 80))]
        df = rows(SCHEMA, *people)
        single = {r.hhid: r.afe for r in afe.household_afe(df).collect()}
        joined = {r.hhid: r.afe for r in afe.household_afe(df, unique_person=False).collect()}
        assert single == pytest.approx(joined)
        info = {r.hhid: r.afe for r in afe.household_information(df).collect()}
        assert info == pytest.approx(single)
        again = {r.hhid: r.afe for r in afe.household_information_joined(df).collect()}
        assert again == pytest.approx(single)

    @pytest.mark.parametrize(("months", "kcal"), [(-1, 0), (2, 0), (3, 76), (5, 76), (6, 269), (8, 269), (9, 451), (11, 451), (12, 746), (24, 746), (None, None)])
    def test_infants(self, rows, months, kcal):
        assert rows("m int", (months,)).select(afe.kcal_under2(F.col("m"))).first()[0] == kcal

    def test_children(self, rows):
        df = rows("sex string, age double", *[(s, float(a)) for s in ("Male", "Female") for a in range(2, 18)], ("Male", 5.5), ("Female", 5.5), ("Female", 16.5), (None, 5.0))
        out = {(r.sex, r.age): r.k for r in df.select("sex", "age", afe.kcal_child(F.col("sex"), F.col("age")).alias("k")).collect()}
        for a in range(2, 18):
            assert out["Male", a] == params.BOY_KCAL[a - 2]
            assert out["Female", a] == (params.GIRL_KCAL[a - 2] if a < 15 else None if a == 15 else 2500)
        assert (out["Male", 5.5], out["Female", 5.5], out["Female", 16.5], out[None, 5.0]) == (None, None, 2500.0, None)
        fixed = df.filter("age = 15 and sex = 'Female'").select(afe.kcal_child(F.col("sex"), F.col("age"), fix_f15=True))
        assert fixed.first()[0] == 2500.0

    @pytest.mark.parametrize(("sex", "age", "bmr"), [
        ("Male", 18, 15.057 * 65 + 692.2), ("Male", 29, 15.057 * 65 + 692.2), ("Male", 30, 11.472 * 65 + 873.1), ("Male", 60, 11.711 * 65 + 587.7),
        ("Female", 18, 14.818 * 55 + 486.6), ("Female", 59, 8.126 * 55 + 845.6), ("Female", 99, 9.082 * 55 + 658.5)])
    def test_adults(self, rows, sex, age, bmr):
        df = rows("sex string, age double", (sex, float(age)))
        assert df.select(afe.kcal_adult(F.col("sex"), F.col("age"))).first()[0] == pytest.approx(bmr * 1.76)

    def test_household_without_a_need(self, rows):
        df = rows(SCHEMA, person(1, "Female", 15, hh="girl"), person(2, "Male", 1, 2017.0, None, hh="infant"))
        assert {r.hhid: r.afe for r in afe.household_afe(df).collect()} == {"girl": 0.0}
        assert {r.hhid: r.afe for r in afe.household_information(df).collect()} == {"girl": 0.0, "infant": None}

    def test_sentinel(self, rows):
        assert [r.age for r in afe.recode_sentinel(rows("age double", (-9998.0,), (3.0,), (None,))).collect()] == [0.0, 3.0, None]


class TestWealth:
    def test_table(self, rows):
        aggregates = rows("interview_id string, cons_aeq_adj double, exp_aeq_month double", *[(f"i{i}", float(i), 10.0 * i) for i in range(10)], ("i0", -1.0, 0.0))
        roster = rows("hhid string, interview_id string", *[(f"h{i}", f"i{i}") for i in range(10)] * 2)
        per_hh = wealth.consumption_per_hh(aggregates, roster)
        assert {r.hhid: r.cons_aeq_adj for r in per_hh.collect()}["h0"] == -1.0
        hh = rows("hhid string, adm1 string, res string, survey_wgt double, year int, month int, afe double",
                  *[(f"h{i}", "R", ["Urban", "Rural"][i % 2], 1.0, 2018, 1, 2.0) for i in range(9)], ("x", "R", None, 1.0, 2018, 1, 2.0))
        out = {r.hhid: r for r in wealth.finalise_households(hh, wealth.with_quintiles(per_hh, hh), "ZZZ", "s").collect()}
        assert [out[f"h{i}"].sep_quintile for i in range(9)] == [1, 1, 2, 2, 3, 3, 4, 4, 5]
        assert [out[f"h{i}"].res_quintile for i in range(0, 9, 2)] == [1, 2, 3, 4, 5]
        assert (out["x"].sep_quintile, out["x"].res_quintile, out["x"].zone) == (None, None, None)
        assert list(out["x"].asDict()) == wealth.HOUSEHOLD_COLUMNS
