import datetime

import pytest

from larder import params
from larder.operators import contribution, coverage, food_groups, regions, scenario
from larder.operators.intake import apparent_intake
from larder.sources.tables import Survey, decode, decode_with, labels_dim


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def survey(rows):
    hh = rows("hhid string, afe double", ("a", 2.0), ("b", 0.0), ("c", None), ("d", 1.0), (None, 4.0))
    food = rows("hhid string, item_code int, quantity_100g double",
                ("a", 1, 2.0), ("a", 2, 1.0), ("a", 9, 5.0), ("a", None, 1.0), ("b", 1, 1.0), ("c", 1, 1.0),
                ("d", 3, 1.0), ("d", 1, None), (None, 1, 4.0), ("x", 1, 1.0))
    fct = rows("item_code int, item_name string, zn_mg double, fe_mg double",
               (1, "maize", 10.0, 1.0), (2, "beans", 4.0, None), (3, "oil", None, None), (None, "mix", 6.0, 2.0))
    return Survey(hh, food, fct)


class TestIntake:
    def test_missing_rules(self, survey):
        out = {r.hhid: (r.zn_mg, r.fe_mg) for r in apparent_intake(survey, ["zn_mg", "fe_mg"]).collect()}
        assert out == {
            "a": (15.0, 2.0),       # an item without composition adds nothing; a missing code finds its row
            "b": (None, None),      # AFE 0
            "c": (None, None),      # AFE unknown
            "d": (0.0, 0.0),        # nothing known sums to 0
            None: (10.0, 1.0),      # a missing household finds its row
            "x": (None, None),      # household not in the table
        }

    def test_keep(self, survey):
        assert apparent_intake(survey, ["zn_mg"], ["afe"]).columns == ["hhid", "zn_mg", "afe"]


class TestScenario:
    def test_replaces_in_order(self, rows):
        fct = rows("item_code int, zn_mg double, fe_mg double", (1, 9.0, 9.0), (2, 9.0, 9.0), (3, 9.0, 9.0), (None, 9.0, 9.0))
        first = scenario.Vehicle({1: 1.0, 2: 1.0}, {"zn_mg": 2.0, "fe_mg": 4.0}, {"zn_mg": 0.5})
        second = scenario.Vehicle([2], {"zn_mg": 8.0})
        out = scenario.fortify_all(fct, [first, second])
        assert got(out) == [(1, 1.0, 4.0), (2, 8.0, 4.0), (3, 9.0, 9.0), (None, 9.0, 9.0)]

    def test_standard_vehicles_share_no_item(self):
        codes = [c for v in scenario.STANDARD_VEHICLES for c in v.items]
        assert len(codes) == len(set(codes)) == 20

    def test_no_vehicle_changes_nothing(self, survey):
        n = ["zn_mg", "fe_mg"]
        assert got(scenario.fortification_scenario(survey, n, [])) == got(apparent_intake(survey, n))


class TestContribution:
    @pytest.fixture
    def many(self, rows):
        hh = rows("hhid string, afe double", ("a", 1.0), ("b", 1.0), ("z", 0.0))
        items = range(1, 31)
        food = rows("hhid string, item_code int, quantity_100g double",
                    *[("a", i, 1.0) for i in items], *[("b", i, float(i)) for i in items], ("z", 1, 99.0), ("n", 2, 99.0))
        fct = rows("item_code int, item_name string, zn_mg double", *[(i, f"food {i:02d}", 1.0 if i < 30 else 0.0) for i in items])
        flags = rows("hhid string, zn_mg_inadequate int", ("a", 1), ("b", 0), ("n", None))
        return Survey(hh, food, fct), flags

    def test_shares_sum_to_hundred(self, many):
        survey, flags = many
        out = contribution.food_contributions_all(survey, flags, ["zn_mg"])
        sums = {r.grp: r[1] for r in out.groupBy("grp").sum("contribution_pct").collect()}
        assert sums == pytest.approx({"total": 100, "risk": 100, "not_risk": 100})
        risk = out.filter("grp = 'risk'").orderBy("contribution_pct", "item_code").collect()
        assert [r.item_code for r in risk] == list(range(1, 30))  # ties by code; the item without zinc is left out

    def test_long_lists_stay_whole(self, rows):
        items = range(1, 401)
        hh = rows("hhid string, afe double", ("a", 1.0))
        food = rows("hhid string, item_code int, quantity_100g double", *[("a", i, 1.0) for i in items])
        fct = rows("item_code int, item_name string, zn_mg double", *[(i, f"food {i:03d}", 1.0) for i in items])
        shares = contribution.food_contributions_all(Survey(hh, food, fct), None, ["zn_mg"], ["total"])
        assert shares.count() == 400
        assert shares.groupBy().sum("contribution_pct").first()[0] == pytest.approx(100)
        top = contribution.top_n_others(shares).orderBy("rank").collect()
        assert [r.item_name for r in top[:3]] == ["food 001", "food 002", "food 003"]  # ties by code
        assert top[20].contribution_pct == 95.0

    def test_group_needs_flags(self, many):
        with pytest.raises(ValueError):
            contribution.food_contribution(many[0], None, "zn_mg", "risk")
        with pytest.raises(ValueError):
            contribution.food_contribution(*many, "zn_mg", "other")

    def test_table_fills_with_zero(self, rows):
        ranked = rows("nutrient string, grp string, item_code int, item_name string, contribution_pct double",
                      ("zn_mg", "total", 1, "a", 60.0), ("zn_mg", "risk", 2, None, 30.0), ("zn_mg", "not_risk", 1, "a", 10.0))
        table = contribution.contribution_table(ranked)
        assert got(table) == [("zn_mg", 1, "a", 60.0, 0.0, 10.0, 10.0), ("zn_mg", 2, None, 0.0, 30.0, 0.0, -30.0)]
        assert [r.item_name for r in contribution.top_delta(table, 1).collect()] == ["a"]

    def test_others(self, many):
        survey, flags = many
        out = contribution.top_n_others(contribution.food_contributions_all(survey, None, ["zn_mg"], ["total"]))
        by_rank = {r["rank"]: r for r in out.collect()}
        assert len(by_rank) == 21
        assert by_rank[21].item_name == "Others"
        weight = {i: 1.0 + i for i in range(1, 30)}
        rest = sum(sorted(weight.values())[:9]) / sum(weight.values()) * 100
        assert by_rank[21].contribution_pct == round(rest)

    def test_others_is_there_when_empty(self, rows):
        ranked = rows("nutrient string, grp string, item_code int, item_name string, contribution_pct double",
                      ("zn_mg", "total", 1, "a", 100.0))
        assert [(r.item_name, r.contribution_pct, r.label) for r in contribution.top_n_others(ranked).orderBy("rank").collect()] == [
            ("a", 100.0, "a\n100%"), ("Others", 0.0, "Others\n0%")]


class TestFoodGroups:
    def test_shares(self, spark, rows):
        food = rows("hhid string, item_code int, quantity_100g double", ("a", 1, 2.0), ("a", 2, 1.0), ("b", 3, 4.0), ("b", 4, 1.0), ("no", 1, 50.0))
        hh = rows("hhid string, afe double", ("a", 1.0), ("b", 2.0))
        fct = rows("item_code int, energy_kcal double", (1, 10.0), (2, 30.0), (3, 20.0), (4, None))
        groups = rows("item_code int, food_group string", (1, "pulses"), (2, "eggs"), (3, "unheard of"))
        energy = food_groups.group_energy(food_groups.regroup(
            food_groups.item_energy(food_groups.item_quantity(food, hh), fct, groups), params.food_group_frame(spark)))
        main = {r.food_group_new: (round(r.energypct, 6), r["rank"], r.label) for r in food_groups.energy_share(energy).collect()}
        assert main == {"Nutritious foods": (round(500 / 9, 6), 1, "56%"), "Other foods": (round(400 / 9, 6), 2, "44%")}
        detail = {r.food_group_new: round(r.energypct, 6) for r in food_groups.energy_share(energy, breakdown=True).collect()}
        assert detail == {"Nuts, seeds and pulses": round(200 / 9, 6), "Animal source foods": round(300 / 9, 6)}

    def test_every_group_is_mapped(self):
        assert set(params.NUTRITIOUS_GROUPS) <= set(params.FOOD_GROUPS.values())


class TestRegions:
    def test_conform(self, rows):
        dim = rows("adm1 string", ("Mjini Magharibi",), ("Dar-es-salaam",), ("Mara",), (None,))
        assert got(regions.conform_regions(dim)) == [("Dar Es Salaam",), ("Mara",)]

    def test_join_sides(self, rows):
        est, dim = rows("adm1 string, v double", ("a", 1.0), ("x", 2.0)), rows("adm1 string", ("a",), ("b",))
        assert got(regions.join_regions(est, dim)) == [("a", 1.0), ("x", 2.0)]
        assert got(regions.join_regions(est, dim, "regions")) == [("a", 1.0), ("b", None)]

    def test_labels(self, rows):
        df = rows("n string, v double", ("a", 61.0), ("b", 2.5), (None, 1.0), ("c", None))
        assert [r.label for r in regions.label_rows(df, "n", "v").collect()] == ["a\n61%", "b\n2.5%"]

    def test_decode(self, spark, rows):
        df = rows("adm1 int, sex int", (7, 1), (99, 9), (None, None))
        assert got(decode(df, "sex", params.SEX_LABELS).select("sex")) == [("Male",), (None,), (None,)]
        assert got(decode_with(df, "adm1", labels_dim(spark, params.REGION_LABELS)).select("adm1")) == [("Dar Es Salaam",), (None,), (None,)]


class TestCoverage:
    SCHEMA = ("id int, v005 bigint, v024 int, v008 int, v008a int, b3 int, b5 int, b19 int, h33d int, h33m int, h33y int, h34 int")

    def child(self, i, **over):
        # Interviewed 2022-06-15 (CMC 1470, day 44727), born 24 months earlier.
        base = dict(id=i, v005=2000000, v024=1, v008=1470, v008a=44727, b3=1446, b5=1, b19=None, h33d=None, h33m=98, h33y=9998, h34=0)
        return tuple((base | over).values())

    def test_children(self, rows):
        df = rows(self.SCHEMA,
                  self.child(1), self.child(2, h34=1), self.child(3, h33y=2022, h33m=1, h33d=1), self.child(4, h33y=2021, h33m=1, h33d=1),
                  self.child(5, h33y=2022, h33m=2, h33d=30), self.child(6, h33y=2022, h33m=3, h33d=98), self.child(7, h33y=2022, h33m=8, h33d=None),
                  self.child(8, b5=0, h34=1), self.child(9, b19=5, h34=1), self.child(10, b19=59, h34=None), self.child(11, b5=None, h34=1),
                  self.child(12, b19=None, b3=None))
        out = {r.id: r for r in coverage.child_vas(df).collect()}
        assert {i: r.vas_child for i, r in out.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1, 8: None, 9: None, 10: 0, 11: 1, 12: 0}
        assert [out[i].eligible_child for i in (1, 8, 9, 10, 11, 12)] == [1, 0, 0, 1, None, None]
        assert out[5].dose_date is None                        # 30 February
        assert out[6].dose_date == datetime.date(2022, 3, 15)  # unknown day
        assert out[7].dose_date == datetime.date(2022, 8, 15) and out[7].months_since_vita < 0
        assert out[3].months_since_vita == pytest.approx((44727 - (22646 + 21916)) / 30.4375)
        assert coverage.late_doses(coverage.child_vas(df)).first()[0] == 1
        assert coverage.vas_coverage(coverage.child_vas(df)).first()[0] == pytest.approx(100 * 4 / 8)

    def test_named_and_target(self, rows):
        cov = rows("adm1 int, vas_coverage double", (1, 79.6), (2, 79.4), (3, 90.0), (4, 50.0))
        labels = rows("code int, label string", (1, "dar es salaam"), (2, "mara"), (3, "kusini pemba"))
        named = coverage.vas_region_named(cov, labels)
        assert [tuple(r) for r in named.collect()] == [("Dar Es Salaam", 80.0), ("Mara", 79.0)]
        dim = rows("adm1 string", ("Dar Es Salaam",), ("Mara",), ("Geita",))
        assert got(coverage.target_class(named, dim)) == [
            ("Dar Es Salaam", 80.0, "80% or above"), ("Geita", None, None), ("Mara", 79.0, "Below 80%")]
