"""Parameters against values typed out: queries and their SQL share ``params``, so they can't tell a wrong digit."""

from larder import params
from larder.functions.stats import Z_975

BANDS = "1 0.96 0.93 0.85 0.75 0.65 0.55 0.45 0.35 0.25 0.15 0.08 0.04 0"
EDGES = {
    5: "15 16.7 18.7 21.4 23.6 25.7 27.8 30.2 33.2 37.3 45 53.5 63",
    10: "7.5 8.4 9.4 10.7 11.8 12.9 13.9 15.1 16.6 18.7 22.5 26.7 31.5",
    15: "5 5.6 6.2 7.1 7.9 8.6 9.3 10.1 11.1 12.4 15 17.8 21",
}


def numbers(text):
    return tuple(float(x) for x in text.split())


def test_requirements():
    assert params.REQUIREMENT == dict(
        energy_kcal=2100, vita_rae_mcg=490, thia_mg=0.9, ribo_mg=1.3, niac_mg=11, vitb6_mg=1.3, folate_mcg=250, vitb12_mcg=2,
        fe_mg=22.4, ca_mg=860, zn_mg=10.2)
    assert params.VARIATION == dict(vita_rae_mcg=0.2, folate_mcg=0.1, vitb12_mcg=0.1, zn_mg=0.125)


def test_iron():
    assert params.IRON_PROBABILITY == numbers(BANDS)
    assert params.IRON_EDGES == {k: numbers(v) for k, v in EDGES.items()}


def test_energy_needs():
    assert params.BOY_KCAL == numbers("1125 1250 1350 1475 1575 1700 1825 1975 2150 2350 2550 2775 3000 3175 3325 3400")
    assert params.GIRL_KCAL == numbers("1050 1150 1250 1325 1425 1550 1700 1850 2000 2150 2275 2375 2450")
    assert params.OLDER_GIRL_KCAL == 2500
    assert params.INFANT_KCAL == ((None, 2, 0), (3, 5, 76), (6, 8, 269), (9, 11, 451), (12, None, 746))
    assert params.MALE_BMR == ((18, 15.057, 692.2), (30, 11.472, 873.1), (60, 11.711, 587.7))
    assert params.FEMALE_BMR == ((18, 14.818, 486.6), (30, 8.126, 845.6), (60, 9.082, 658.5))
    assert (params.ACTIVITY_LEVEL, params.KCAL_PER_AFE, params.MALE_KG, params.FEMALE_KG) == (1.76, 2291, 65, 55)


def test_vehicles():
    assert params.MAIZE_LEVELS == dict(vitb12_mcg=0.5, fe_mg=1.5, zn_mg=2.25, folate_mcg=150)
    assert params.WHEAT_LEVELS == dict(vitb12_mcg=1.5, fe_mg=4, zn_mg=4, folate_mcg=300)
    assert params.FLOUR_LOSSES == dict(vitb12_mcg=0.15, folate_mcg=0.17, fe_mg=0, zn_mg=0)
    assert (params.OIL_LEVELS, params.OIL_LOSSES) == ({"vita_rae_mcg": 1700}, {"vita_rae_mcg": 0.32})


def test_normal_quantile():
    assert abs(Z_975 - 1.959963984540054) < 1e-12
