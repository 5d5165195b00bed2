import os

import pytest
from pyspark.sql import functions as F

from larder import catalogue, params
from larder.operators import checks, food_groups
from larder.operators.intake import apparent_intake
from larder.operators.joins import na_join
from larder.operators.ordering import ntile_exact
from larder.plans import reports
from larder.plans.base_model import RawSurvey, build
from larder.sources import schemas, staging, tables
from larder.sources.adapters import ISO3, SURVEY, Tables
from larder.sources.staging import stage, staging_root
from larder.sources.tables import Survey


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


class TestFiles:
    def test_csv_by_header_with_missing(self, spark, tmp_path):
        path = tmp_path / "demo_food_consumption.csv"
        path.write_text("item_code,extra,hhid,survey,iso3,quantity_g,quantity_100g\n7,x,007,s,ZZZ,NA,1.5\nNA,y,NA,s,ZZZ,2,NaN\n")
        df = tables.read_table(spark, str(path), schemas.FOOD_CONSUMPTION)
        assert df.columns == schemas.FOOD_CONSUMPTION.names
        assert got(df.select("hhid", "item_code", "quantity_g", "quantity_100g")) == [("007", 7, None, 1.5), (None, None, 2.0, None)]

    def test_missing_column_is_an_error(self, spark, tmp_path):
        path = tmp_path / "x.csv"
        path.write_text("adm2\na\n")
        with pytest.raises(ValueError, match="adm1"):
            tables.read_table(spark, str(path), schemas.REGIONS)

    def test_survey_by_name(self, spark, rows, tmp_path):
        columns = schemas.HH_INFORMATION.names
        (tmp_path / "s_hh_information.csv").write_text(",".join(columns) + "\ns,1,ZZZ,NA,R,NA,NA,Urban,1,2,2018,1,1.5,2.5,10\n")
        (tmp_path / "s_food_consumption.csv").write_text("iso3,survey,hhid,item_code,quantity_g,quantity_100g\nZZZ,s,1,5,100,1\n")
        (tmp_path / "s_fct.csv").write_text("iso3,survey,item_code,item_name,zn_mg\nZZZ,s,5,beans,5\n")
        survey = tables.read_survey(spark, "s", str(tmp_path), ["zn_mg"])
        assert got(apparent_intake(survey, ["zn_mg"])) == [("1", 2.0)]

    @pytest.mark.parametrize("fmt", ["csv", "parquet"])
    def test_round_trip(self, spark, rows, tmp_path, fmt):
        df = rows("adm1 string, micronutrient string, estimate double", ("a", "zn", 0.1), (None, "zn", None))
        target = tables.write_table(df, str(tmp_path), "1", fmt)
        assert got(tables.read_table(spark, target, schemas.REGION_ESTIMATES)) == got(df)
        with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
            tables.write_table(df, str(tmp_path), "1", fmt)

    def test_report_has_a_folder_per_nutrient(self, rows, tmp_path):
        df = rows("nutrient string, v int", ("zn", 1), ("fe", 2))
        target = tables.write_report(df, str(tmp_path))
        assert {d for d in os.listdir(target) if d.startswith("nutrient=")} == {"nutrient=zn", "nutrient=fe"}

    def test_stage_is_under_the_named_folder(self, spark, rows):
        df = rows("x int", (1,), (None,))
        root = staging_root(spark).removeprefix("file:")
        staged = stage(df)
        assert got(staged) == got(df)
        assert all(f.removeprefix("file:").lstrip("/").startswith(root.strip("/")) for f in staged.inputFiles())


class TestChecks:
    def test_summary(self, rows):
        df = rows("id int, v double", *[(i, float(v)) for i, v in enumerate([4, 1, 3, 2])], (9, None))
        r = checks.summary_stats(df, "v", ["id"]).first()
        assert tuple(r) == (1.0, 1.75, 2.5, 2.5, 3.25, 4.0, 1)

    def test_histogram(self, rows):
        df = rows("v double", (0.0,), (9.9,), (10.0,), (99.9,), (100.0,), (-1.0,), (None,))
        out = {r.bin: (r.n, r.bin_start) for r in checks.histogram(df, "v", 0, 100, 10).collect()}
        assert out == {1: (2, 0.0), 2: (1, 10.0), 10: (1, 90.0)}

    def test_mean_by(self, rows):
        df = rows("x int, y double", (1, 1.0), (1, 3.0), (2, 4.0), (3, 6.0))
        out = {r.x: (r.n, r.mean_y) for r in checks.mean_by(df, "y", "x").collect()}
        assert out == {1: (2, 2.0), 2: (1, 4.0), 3: (1, 6.0)}
        slopes = {round(r.slope, 9) for r in checks.mean_by(df, "y", "x").collect()}
        assert slopes == {2.0}

    def test_constant_has_no_slope(self, rows):
        df = rows("x int, y double", (1, 1.0), (1, 3.0))
        assert checks.mean_by(df, "y", "x").first().slope is None

    @pytest.mark.parametrize("degree", [0, 1, 2])
    def test_smooth(self, rows, degree):
        """Against a weighted least-squares fit over the rows themselves."""
        import numpy as np

        draw = np.random.default_rng(3)
        x, y = draw.integers(1, 12, 300).astype(float), draw.random(300)
        df = rows("x double, y double", *zip(x.tolist(), y.tolist(), strict=True), (None, 1.0), (3.0, None))
        got = {r["at"]: (r.n, r.smooth_y) for r in checks.smooth(df, "y", "x", [1, 4.5, 7, 20, 7], span=0.6, degree=degree).collect()}
        assert sorted(got) == [1, 4.5, 7, 20]
        for at, (n, value) in got.items():
            d = np.abs(x - at)
            q = np.sort(d)[int(np.ceil(0.6 * 300)) - 1]
            w = np.where(d < q, (1 - (d / q) ** 3) ** 3, 0)
            fit = np.polyfit(x - at, y, degree, w=np.sqrt(w))
            assert n == (w > 0).sum() and value == pytest.approx(fit[-1])

    def test_smooth_follows_a_curve(self, rows):
        df = rows("x double, y double", *[(i / 10, (i / 10) ** 2 - i) for i in range(100)])
        for r in checks.smooth(df, "y", "x", [0.0, 3.3, 9.9], span=0.3).collect():
            assert r.smooth_y == pytest.approx(r["at"] ** 2 - 10 * r["at"], abs=1e-8)

    def test_smooth_of_few_values(self, rows):
        one = rows("x int, y double", (2, 1.0), (2, 3.0), (2, None))
        assert sorted((r["at"], r.n, r.smooth_y) for r in checks.smooth(one, "y", "x", [2, 5]).collect()) == [(2, 2, 2.0), (5, 2, 2.0)]
        two = rows("x int, y double", (1, 1.0), (2, 3.0), (4, 9.0))
        assert {r["at"]: r.smooth_y for r in checks.smooth(two, "y", "x", [1], span=1.0).collect()}[1] == pytest.approx(1.0)
        assert checks.smooth(one.limit(0), "y", "x", [1]).count() == 0
        with pytest.raises(ValueError):
            checks.smooth(one, "y", "x", [1], degree=3)

    def test_log_log(self, rows):
        df = rows("x double, y double", (1.0, 2.0), (10.0, 200.0), (0.0, 1.0), (-1.0, 1.0), (None, 1.0))
        r = checks.log_log_fit(df, "y", "x").first()
        assert (r.n, round(r.slope, 9), round(r["corr"], 9)) == (2, 2.0, 1.0)


class TestPlans:
    def test_base_model(self, spark, sf_dir, tmp_path):
        """The whole job on adapter tables, against its parts run one by one."""
        t = Tables(spark, sf_dir)
        raw = RawSurvey(t.diary(), t.edible(), t.persons().drop("year", "month"),
                        na_join(t.cons_agg(), t.hh_date(), "interview_id"), t.fct())
        model = build(raw, str(tmp_path), ISO3, SURVEY, ["zn_mg", "energy_kcal"])
        hh, food = spark.read.parquet(model.households), spark.read.parquet(model.consumption)
        intake = spark.read.parquet(model.intake)
        assert hh.count() == t.persons().select("hhid").distinct().count() == hh.select("hhid").distinct().count()
        assert hh.filter("sep_quintile is null or year is null").count() == 0
        sizes = [r["count"] for r in hh.groupBy("sep_quintile").count().collect()]
        assert max(sizes) - min(sizes) <= 1
        assert intake.count() == food.select("hhid").distinct().count()
        assert food.filter("quantity_g is null or quantity_g <= 0").count() == 0
        assert got(apparent_intake(model.survey(spark, t.fct()), ["zn_mg"]).agg(F.round(F.sum("zn_mg"), 6))) == got(
            intake.agg(F.round(F.sum("zn_mg"), 6)))

    def test_reports(self, spark, sf_dir, tmp_path):
        """Every report gives what the single queries give."""
        t = Tables(spark, sf_dir)
        hh = ntile_exact(ntile_exact(t.hh(), "pc_expenditure", 5, ["hhid"], "sep_quintile"),
                         "pc_expenditure", 5, ["hhid"], "res_quintile", by=["res"])
        keep = ["survey_wgt", "adm1", "res", "sep_quintile", "res_quintile"]
        households = stage(apparent_intake(Survey(hh, t.cons(), t.fct()), params.NUTRIENTS, keep))
        single = {name: q.run(t) for name, q in catalogue.load().items()
                  if name in ("mpi_gradient", "mpi_region_ci", "mpi_national_se", "long_region", "long_national", "long_residence",
                              "long_res_quintile", "urban_rural_gap", "vas_target", "vas_national", "contrib_top5", "top20_report",
                              "energy_share_main", "energy_share_nutritious")}

        def same(df, name, *names):
            other = single[name].toDF(*names) if names else single[name]
            assert got(catalogue.rounded(df.select(*other.columns))) == got(catalogue.rounded(other)), name

        mpi = reports.mpi_report(households, "survey_wgt")
        same(mpi["gradient"], "mpi_gradient")
        same(mpi["national"], "mpi_national_se", "mean_mpi", "mean_mpi_se", "mean_mpi_low", "mean_mpi_upp")
        same(mpi["region"], "mpi_region_ci", "adm1", "mean_mpi", "mean_mpi_se", "mean_mpi_low", "mean_mpi_upp")
        long = reports.stratified_report(households, "survey_wgt")
        same(long["region"], "long_region")
        same(long["national"], "long_national")
        same(long["residence"], "long_residence")
        same(long["residence_quintile"], "long_res_quintile")
        same(long["gap"], "urban_rural_gap")
        energy = reports.energy_report(t.cons(), t.hh(), t.fct(), t.food_group_map())
        same(catalogue.rounded(energy.filter("part = 'main'"), 2, "totalenergy_kcal"), "energy_share_main")
        same(catalogue.rounded(energy.filter("part = 'nutritious'"), 2, "totalenergy_kcal"), "energy_share_nutritious")
        regions = t.region_dim().select(F.initcap("adm1").alias("adm1"))
        vas = reports.coverage_report(t.children(), t.region_codes(), regions, "Nation_2[34]")
        same(vas["region"], "vas_target")
        same(vas["national"], "vas_national")
        paths = reports.contribution_report(t.survey(), households, str(tmp_path))
        same(spark.read.parquet(paths["delta"]), "contrib_top5")
        same(spark.read.parquet(paths["top20"]), "top20_report")

    def test_scan_reads_only_what_it_needs(self, spark, sf_dir):
        t = Tables(spark, sf_dir)
        plan = apparent_intake(t.survey(), ["zn_mg"])._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
        assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in plan

    @pytest.mark.parametrize("name", ["apparent_intake", "mpa_rows", "mpi_region_ci", "mpi_gradient", "region_report",
                                      "household_afe", "kcal_under2", "contrib_all", "vas_child"])
    def test_generated_methods_are_compilable(self, spark, sf_dir, name):
        """No generated method exceeds the 8000 bytes beyond which the JVM only interprets it."""
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        try:
            df = catalogue.load()[name].run(Tables(spark, sf_dir))
            df.collect()
            debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
            stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        finally:
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        assert sizes and max(sizes) < 8000

    def test_hot_household_is_split(self, spark):
        """Adaptive execution splits a household that holds most rows, when nothing is broadcast."""
        settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
                    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
        before = {k: spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            food = spark.range(0, 200000, 1, 8).select(
                F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 500).alias("hhid"),
                (F.col("id") % 100).alias("item_code"), F.rand(1).alias("quantity_100g"))
            hh = spark.range(500).select(F.col("id").alias("hhid"), F.lit(2.0).alias("afe"))
            df = food_groups.item_quantity(food, hh)
            assert df.count() == 100
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "skew=true" in plan
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_parameters_are_complete():
    assert len(params.IRON_PROBABILITY) == 14
    assert all(len(e) == 13 and list(e) == sorted(e) for e in params.IRON_EDGES.values())
    assert (len(params.BOY_KCAL), len(params.GIRL_KCAL), len(params.REGION_LABELS)) == (16, 13, 26)


class TestStaging:
    def test_threads_own_their_own_stages(self, spark):
        """A thread that ends its block leaves another thread's stages alone."""
        import threading

        made, first_done, both_made = {}, threading.Event(), threading.Barrier(2)

        def work(name):
            with staging.owned(spark):
                made[name] = stage(spark.range(3))
                both_made.wait(60)
                if name == "late":
                    first_done.wait(60)
                    made["count"] = made["late"].count()
            first_done.set()

        threads = [threading.Thread(target=work, args=(n,)) for n in ("early", "late")]
        for t in threads:
            t.start()
        for t in threads:
            t.join(120)
        assert made["count"] == 3
        assert not any(os.path.exists(f.removeprefix("file://")) for n in ("early", "late") for f in made[n].inputFiles())

    def test_a_finished_job_leaves_nothing(self, spark, rows):
        with staging.owned(spark):
            df = staging.stage(rows("a int", (1,), (2,)))
            folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
            assert df.count() == 2 and os.path.isdir(folder)
        assert not os.path.exists(folder)


class TestDimensions:
    def test_repeated_codes_are_refused(self, rows):
        facts = rows("code int", (1,), (2,), (None,))
        dim = rows("code int, label string", (1, "a"), (None, "none"))
        assert sorted(str(r.code) for r in tables.decode_with(facts, "code", dim).collect()) == ["None", "a", "none"]
        twice = rows("code int, label string", (1, "a"), (1, "b"))
        with pytest.raises(Exception, match="more than one row for _code 1"):
            tables.decode_with(facts, "code", twice).collect()

    def test_no_forced_broadcast(self, spark, rows):
        dim = spark.range(2_000_000).select(F.col("id").cast("int").alias("code"), F.sha2(F.col("id").cast("string"), 256).alias("label"))
        plan = tables.decode_with(rows("code int", (1,)), "code", dim)._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" not in plan.lower()
