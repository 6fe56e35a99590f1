"""Fixed values the surveys are processed with.

They are data, not logic: taxon groups, analytes, rank names and column names that must
be these for the results to be right.
"""

# Trait labels and the letters one survey uses for them.
MIXOTROPH = "Mixotroph"
AUTOTROPH = "Autotroph"
TROPHIC_CODES = {"a": "Autotroph", "m": "Mixotroph", "h": "Heterotroph"}

# Group name of cyanobacteria in the algal classification.
CYANOBACTERIA = "CYANOBACTERIA"

# Ranks of the algal taxonomy and of the bacterial one.
TAXONOMY_RANKS = ["Empire", "Kingdom", "Phylum", "Class", "Order", "Family", "Genus"]
COMPOSITION_RANKS = [*TAXONOMY_RANKS, "strat"]
BACTERIA_RANKS = ["Phylum", "Class", "Order", "clade", "lineage", "tribe"]

# Zooplankton groups, genus names spelled out.
ZOOPLANKTON_GROUPS = {
    "cladocera": [
        "Daphnia", "Acroperus", "Alona", "Alonella", "Bosmina", "Camptocercus",
        "Ceriodaphnia", "Chydorus", "Diaphanosoma", "Eubosmina", "Holopedium",
        "Macrothrix", "Picripleuroxus", "Pleuroxus", "Polyphemus", "Sida",
        "Simocephalus", "Dunhevedia", "Graptoleberis", "Ilyocryptus", "Latona",
        "Moina", "Eurycercus", "Scapholeberis",
    ],
    "copepoda": [
        "Ergasilus", "harpacticoid", "Acanthocyclops", "Cyclops", "Diacyclops",
        "Eucyclops", "Mesocyclops", "Microcyclops", "Orthocyclops", "Tropocyclops",
        "cyclopoid", "Aglaodiaptomus", "Epischura", "Leptodiaptomus", "Limnocalanus",
        "Onychodiaptomus", "Senecella", "Skistodiaptomus", "calanoid", "Macrocyclops",
        "Acanthodiaptomus", "Hesperodiaptomus", "Heterocope",
    ],
    "other": ["ostracod"],
}

# Zooplankton groups, abbreviated taxon codes.
ZOOPLANKTON_CODE_GROUPS = {
    "cladocera": [
        "Alona", "Alonop", "Algla", "Bosmi", "Bosmina", "Chydo", "Cerio", "Daphn",
        "Eubos", "Eubo", "Eurycercus", "Holop", "Ilyocryptus", "Laton", "Lepto",
        "Macrothrix", "Moina", "Neobos", "Onycho", "Ophryo", "Ortho", "Polyp", "Sida",
        "Sinobos", "Sino", "Tropo", "Clado_imm",
    ],
    "copepoda": [
        "Acant", "Acrop", "Calanoida", "Cyclopoida", "Cyc", "Cyclo", "Diacyclops",
        "Diacy", "Eucyc", "Episc", "Harpacticoida", "Mesoc", "Mcycl", "Cal", "Paracy",
    ],
    "other": ["nauplii"],
}

# Chemistry: pivoted "analyte_unit" names and the name of their daily mean.
CHEMISTRY_MEANS = {
    "ALK_ueq.L": "mean_ALK_ueq.L",
    "CA_mg.L": "mean_CA_mg.L",
    "CHLA_ug.L": "mean_CHLA_ug.L",
    "CL_mg.L": "mean_CL_mg.L",
    "COND_uS.cm": "mean_COND_uS.cm",
    "DIC_umol.L": "mean_DIC_umol.L",
    "DOC_umol.L": "mean_DOC_umol.L",
    "FE_mg.L": "mean_FE_mg.L",
    "K_mg.L": "mean_K_mg.L",
    "MG_mg.L": "mean_MG_mg.L",
    "MN_mg.L": "mean_MN_mg.L",
    "SO_mg.L": "mean_SO_mg.L",
    "NH3_ug.L": "mean_NH3_ug.L",
    "NO2_ug.L": "mean_NO2_ug.L",
    "NO3_ug.L": "mean_NO3_ug.L",
    "PARTC_ug.L": "mean_PARTC_ug.L",
    "PARTP_ug.L": "mean_PARTP_ug.L",
    "PH_": "mean_pH",
    "SO4_mg.L": "mean_SO4_mg.L",
    "SRSI_mg.L": "mean_SRSI_mg.L",
    "TDN_ug.L": "mean_TDN_ug.L",
    "TDP_ug.L": "mean_TDP_ug.L",
    "PARTN_ug.L": "mean_PARTN_ug.L",
    "O2_mg.L": "mean_DO_mg.L",
    "PARTFE_ug.L": "mean_PARTFE_ug.L",
    "COLOUR_": "mean_COLOUR",
    "A254_m^-1": "mean_A254_m_m1",
    "SR_": "mean_SR",
    "SRP_ug.L": "mean_SRP_ug.L",
}

# An analyte code read as missing: sodium.
SODIUM_CODE = "SO"

# Harmonised site tables: column order of each survey kind.
DIVERSITY = ["rich_genus", "shannon", "op_simpson", "eveness_piel"]
DIVERSITY_CORR = ["rich_genus_corr", "shannon_corr", "op_simpson_corr", "eveness_piel_corr"]
ZOO_TOTALS = [
    "biovol_tot_zoo_um3.mL", "biovol_cladocera_um3.mL",
    "biovol_copepoda_um3.mL", "biovol_other_um3.mL",
]
SITE_BASE = [
    "lat", "long", "area_m2", "depth", "color", "sech_m", "temp_mean", "pH", "Chla_ug.L",
    "DO_mg.L", "DOC_mg.L", "TP_ug.L", "TN_ug.L",
]
SITE_IONS = ["SO_mg.L", "MG_mg.L", "CL_mg.L", "K_mg.L", "COND_uS.cm"]
HARMONISED = {
    "wide": ["lake_id", "yr", "doy", *SITE_BASE, "prev_Mixo", *ZOO_TOTALS, *DIVERSITY],
    "long": [
        "lake_id", *SITE_BASE, *SITE_IONS, *ZOO_TOTALS, *DIVERSITY, "log_LCBD",
        *DIVERSITY_CORR, "log_LCBD_corr", "prev_Mixo",
    ],
    "dated": [
        "lake_id", "yr", "doy", *SITE_BASE, *SITE_IONS, *ZOO_TOTALS, *DIVERSITY,
        *DIVERSITY_CORR, "prev_Mixo",
    ],
}

# Source column -> harmonised column.
HARMONISE_RENAMES = {
    "wide": {
        "doc.mgl": "DOC_mg.L", "chl.ugl": "Chla_ug.L", "sech.m": "sech_m",
        "h2otemp": "temp_mean", "ph": "pH", "do.mgl": "DO_mg.L", "tp.ugl": "TP_ug.L",
        "ctch.m2": "area_m2", "zmax": "depth",
    },
    "long": {
        "DOC": "DOC_mg.L", "Colour": "color", "Chla": "Chla_ug.L", "secchi_depth": "sech_m",
        "latitude": "lat", "longitude": "long", "area": "area_m2", "lake_depth": "depth",
        "Sodium": "SO_mg.L", "Magnesium": "MG_mg.L", "Chloride": "CL_mg.L",
        "Potassium": "K_mg.L", "TP": "TP_ug.L",
    },
    "dated": {
        "mean_COLOUR": "color", "mean_CHLA_ug.L": "Chla_ug.L", "mean_pH": "pH",
        "mean_DO_mg.L": "DO_mg.L", "mean_TDP_ug.L": "TP_ug.L", "mean_TDN_ug.L": "TN_ug.L",
        "area_surface": "area_m2", "depth_max": "depth", "mean_SO_mg.L": "SO_mg.L",
        "mean_MG_mg.L": "MG_mg.L", "mean_CL_mg.L": "CL_mg.L", "mean_K_mg.L": "K_mg.L",
        "mean_COND_uS.cm": "COND_uS.cm",
    },
}

# Source column, factor, harmonised column of the unit conversions.
HARMONISE_UNITS = {
    "wide": [("tn.mgl", 1000.0, "TN_ug.L")],
    "long": [("TN", 1000.0, "TN_ug.L"), ("Conductivity", 1000.0, "COND_uS.cm")],
    "dated": [("mean_DOC_umol.L", 0.012, "DOC_mg.L")],
}

# Surface / bottom pairs averaged per row.
HARMONISE_MEANS = {
    "temp_mean": ["Temperature_up", "Temperature_bottom"],
    "pH": ["pH_up", "pH_bottom"],
    "DO_mg.L": ["DO_up", "DO_bottom"],
}

# Quantities one survey kind does not measure.
UNMEASURED = {"dated": [*ZOO_TOTALS, "sech_m", "temp_mean"]}

# Predictors the smooth model leaves out, per survey kind.
SMOOTH_DROPS = {
    "wide": ["yr"],
    "long": ZOO_TOTALS,
    "dated": ["lat", "long", "area_m2", "depth", *ZOO_TOTALS, "sech_m", "temp_mean"],
}

# Chemistry interpolated over the day of year before smoothing.
INTERPOLATED = [
    "color", "pH", "Chla_ug.L", "DO_mg.L", "DOC_mg.L", "TP_ug.L", "TN_ug.L",
    "SO_mg.L", "MG_mg.L", "CL_mg.L", "K_mg.L", "COND_uS.cm",
]
