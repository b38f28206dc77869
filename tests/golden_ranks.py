"""FX-6: the 45 published dataset-level mean best-J values (15 datasets x 3 samplers)
and the published test results they must reproduce."""

# Published dataset-level means (dataset, sampler, mean_best_j).
GOLDEN_MEANS = [
    ("cancer", "standard_tpe", 0.5942010164751744),
    ("cancer", "multivariate_tpe", 0.6041393853790636),
    ("cancer", "gp", 0.6134757845039459),
    ("alzheimers", "standard_tpe", 0.551888549835258),
    ("alzheimers", "multivariate_tpe", 0.5544781335694112),
    ("alzheimers", "gp", 0.563082362738269),
    ("adult", "standard_tpe", 0.5549618717764967),
    ("adult", "multivariate_tpe", 0.5531714929204891),
    ("adult", "gp", 0.5512038744656466),
    ("forest_cover", "standard_tpe", 0.5375571887857471),
    ("forest_cover", "multivariate_tpe", 0.5398326400635094),
    ("forest_cover", "gp", 0.5489344624138507),
    ("bank_marketing", "standard_tpe", 0.5696168859833907),
    ("bank_marketing", "multivariate_tpe", 0.5679448547559035),
    ("bank_marketing", "gp", 0.5710538945307287),
    ("wine_quality", "standard_tpe", 0.617252601278258),
    ("wine_quality", "multivariate_tpe", 0.6208371725294181),
    ("wine_quality", "gp", 0.6204851097973855),
    ("cdc_diabetes", "standard_tpe", 0.595462009355972),
    ("cdc_diabetes", "multivariate_tpe", 0.5974664290370151),
    ("cdc_diabetes", "gp", 0.6000603730407793),
    ("mushroom", "standard_tpe", 0.5196212247168396),
    ("mushroom", "multivariate_tpe", 0.5198084723946393),
    ("mushroom", "gp", 0.5240973674247089),
    ("magic_gamma", "standard_tpe", 0.6377832196730434),
    ("magic_gamma", "multivariate_tpe", 0.6356987603544291),
    ("magic_gamma", "gp", 0.6404219107320868),
    ("metro_interstate", "standard_tpe", 0.602721188431834),
    ("metro_interstate", "multivariate_tpe", 0.6027416257577051),
    ("metro_interstate", "gp", 0.6077026351254164),
    ("online_shopping", "standard_tpe", 0.4380699827578926),
    ("online_shopping", "multivariate_tpe", 0.44108081710323654),
    ("online_shopping", "gp", 0.4403982572800454),
    ("air_quality", "standard_tpe", 0.6182351369522684),
    ("air_quality", "multivariate_tpe", 0.6167034863543579),
    ("air_quality", "gp", 0.6184386006539756),
    ("concrete", "standard_tpe", 0.6132990715897443),
    ("concrete", "multivariate_tpe", 0.6120666194028344),
    ("concrete", "gp", 0.6117845439418156),
    ("energy_efficiency", "standard_tpe", 0.6011504588320421),
    ("energy_efficiency", "multivariate_tpe", 0.5993517684710671),
    ("energy_efficiency", "gp", 0.5986633209727504),
    ("real_estate", "standard_tpe", 0.576686638986628),
    ("real_estate", "multivariate_tpe", 0.5708510626984107),
    ("real_estate", "gp", 0.5780760572012894),
]

# Published results for the table above.
EXPECTED_AVG_RANK = {"gp": 1.5333333333, "multivariate_tpe": 2.1333333333, "standard_tpe": 2.3333333333}
EXPECTED_FRIEDMAN = {"chi2": 5.2, "p_value": 0.0742735782143343, "kendalls_w": 0.17333333333333}
EXPECTED_WILCOXON = {
    "Standard TPE vs Multivariate TPE": (48.0, 0.52447509765625, 0.52447509765625),
    "Standard TPE vs Gaussian Process": (19.0, 0.01806640625, 0.0361328125),
    "Multivariate TPE vs Gaussian Process": (16.0, 0.01025390625, 0.03076171875),
}
