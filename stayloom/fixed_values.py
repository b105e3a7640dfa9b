"""Keyword searches, imputation groups, categories and markers.

The words and names below must equal those of the original study for the results to match; they are
data, listed in the study's own order.
"""

from __future__ import annotations

# Keywords per feature, searched in the labels of the charted items.
CHART_SEARCH = {
    "heart_rate": ["heart rate"],
    "systolic_bp": ["systolic", "arterial bp", "nbp sys", "abp sys"],
    "diastolic_bp": ["diastolic", "abp dias", "nbp dias"],
    "map": ["mean arterial", "map"],
    "respiratory_rate": ["respiratory rate", "resp rate"],
    "temperature": ["temperature"],
    "spo2": ["spo2", "o2 sat", "oxygen saturation"],
    "gcs_total": ["gcs total", "gcs - total"],
    "gcs_motor": ["gcs motor", "motor response"],
    "gcs_verbal": ["gcs verbal", "verbal response"],
    "gcs_eye": ["gcs eye", "eye opening"],
    "fio2": ["fio2", "fraction of inspired o2", "inspired o2 fraction"],
    "peep": ["peep", "positive end expiratory"],
    "tidal_volume": ["tidal volume"],
    "minute_volume": ["minute volume"],
    "peak_insp_pressure": ["peak insp pressure", "peak inspiratory pressure"],
    "glucose_bedside": ["glucose finger", "glucose (70-105)", "fingerstick glucose"],
    "capillary_refill": ["capillary refill"],
    "weight": ["admit wt", "daily weight", "weight (kg)"],
    "height": ["height"],
    "pupil_right": ["pupil right"],
    "pupil_left": ["pupil left"],
    "pain_score": ["pain score", "pain level"],
}

# Keywords per feature, searched in the labels of the output items.
OUTPUT_SEARCH = {
    "urine_foley": ["urine out foley", "foley"],
    "urine_void": ["urine out void", "void"],
    "urine_condom": ["urine out condom", "condom cath"],
    "urine_nephrostomy": ["nephrostomy"],
    "urine_suprapubic": ["suprapubic"],
    "urine_total": ["urine", "ileoconduit"],
    "stool": ["stool", "fecal", "colostomy", "ileostomy", "rectal tube"],
    "emesis": ["emesis", "vomit"],
    "gastric_tube": ["gastric tube", "nasogastric", "oral gastric", "anderson"],
    "chest_tube": ["chest tube", "pleural"],
    "dialysis_out": ["dialysis out", "hemodialysis", "peritoneal dialysis"],
    "drain": ["jackson pratt", "hemovac", "wound vac", "drain out"],
    "csf": ["csf", "cerebrospinal"],
}

# Keywords per feature, searched in the labels of the input items.
INPUT_SEARCH = {
    "norepinephrine": ["norepinephrine", "noradrenaline", "levophed"],
    "epinephrine": ["epinephrine", "adrenaline"],
    "phenylephrine": ["phenylephrine", "neosynephrine"],
    "vasopressin": ["vasopressin"],
    "dopamine": ["dopamine"],
    "dobutamine": ["dobutamine"],
    "milrinone": ["milrinone"],
    "propofol": ["propofol"],
    "midazolam": ["midazolam", "versed"],
    "fentanyl": ["fentanyl"],
    "morphine": ["morphine"],
    "ketamine": ["ketamine"],
    "dexmedetomidine": ["dexmedetomidine", "precedex"],
    "lorazepam": ["lorazepam", "ativan"],
    "hydromorphone": ["hydromorphone", "dilaudid"],
    "cisatracurium": ["cisatracurium"],
    "vecuronium": ["vecuronium"],
    "rocuronium": ["rocuronium"],
    "insulin_regular": ["insulin regular"],
    "insulin_glargine": ["insulin glargine", "lantus"],
    "insulin_nph": ["insulin nph"],
    "insulin_humalog": ["insulin humalog"],
    "prbc": ["packed red blood", "prbc"],
    "platelets": ["platelet"],
    "ffp": ["fresh frozen plasma", "ffp"],
    "cryoprecipitate": ["cryoprecipitate"],
    "albumin_25": ["albumin 25%"],
    "albumin_5": ["albumin 5%"],
    "hetastarch": ["hetastarch", "hespan"],
    "normal_saline": ["0.9% sodium chloride", "normal saline", "ns "],
    "lr": ["lactated ringers", "lactated ringer"],
    "d5w": ["dextrose 5%", "d5w"],
    "d10w": ["dextrose 10%"],
    "d50": ["dextrose 50%"],
    "tpn": ["tpn", "total parenteral"],
    "enteral": ["ensure", "nutren", "impact", "peptamen"],
    "vancomycin": ["vancomycin"],
    "meropenem": ["meropenem"],
    "piperacillin_tazo": ["piperacillin", "pip/tazo", "zosyn"],
    "cefepime": ["cefepime", "maxipime"],
    "ceftriaxone": ["ceftriaxone", "rocephin"],
    "metronidazole": ["metronidazole", "flagyl"],
    "fluconazole": ["fluconazole", "diflucan"],
    "heparin": ["heparin"],
    "furosemide": ["furosemide", "lasix"],
    "sodium_bicarbonate": ["sodium bicarbonate", "nahco3"],
    "kcl": ["potassium chloride", "kcl"],
}

# Keywords per feature, searched in the labels of the laboratory items.
LAB_SEARCH = {
    "wbc": ["white blood cells", "leukocytes"],
    "hemoglobin": ["hemoglobin"],
    "hematocrit": ["hematocrit"],
    "platelets": ["platelet count"],
    "creatinine": ["creatinine"],
    "bun": ["urea nitrogen"],
    "sodium": ["sodium"],
    "potassium": ["potassium"],
    "chloride": ["chloride"],
    "bicarbonate": ["bicarbonate"],
    "calcium": ["calcium, total", "calcium total"],
    "magnesium": ["magnesium"],
    "phosphate": ["phosphate"],
    "bilirubin_total": ["bilirubin, total", "bilirubin total"],
    "alt": ["alanine aminotransferase"],
    "ast": ["aspartate aminotransferase"],
    "alp": ["alkaline phosphatase"],
    "albumin": ["albumin"],
    "inr": ["inr", "pt - inr"],
    "pt": ["pt", "prothrombin time"],
    "ptt": ["ptt", "partial thromboplastin"],
    "ph_blood": ["ph"],
    "lactate": ["lactate"],
    "po2": ["po2", "partial pressure of oxygen"],
    "pco2": ["pco2", "partial pressure of co2"],
    "o2_sat_blood": ["oxygen saturation"],
    "glucose_lab": ["glucose"],
    "troponin": ["troponin"],
    "crp": ["c reactive protein", "crp"],
    "procalcitonin": ["procalcitonin"],
    "total_protein": ["total protein"],
    "lipase": ["lipase"],
    "amylase": ["amylase"],
    "urine_glucose": ["glucose, urine", "glucose - urine"],
    "urine_protein": ["protein, urine", "protein - urine"],
    "urine_creatinine": ["creatinine, urine"],
}

# Keywords per feature, searched in the labels of the dated items.
DATED_SEARCH = {
    "dialysis": ["last dialysis", "dialysis"],
    "arterial_line": ["arterial line insertion", "a-line insertion"],
    "central_line": ["central line insertion", "central venous line"],
    "picc_line": ["picc line insertion", "picc insertion"],
    "trauma_line": ["trauma line insertion"],
    "midline": ["midline insertion"],
    "icp_line": ["icp line insertion", "intracranial pressure"],
    "dialysis_catheter": ["dialysis catheter insertion"],
    "tandem_heart": ["tandem heart"],
    "swan_ganz": ["swan ganz", "pulmonary artery catheter"],
    "epidural": ["epidural insertion"],
    "chest_tube_insert": ["chest tube insertion date"],
}

# Specimen types and organisms of interest.
SPECIMEN_TYPES = [
    "BLOOD CULTURE", "URINE", "SPUTUM", "BRONCHOALVEOLAR LAVAGE", "WOUND SWAB", "CATHETER TIP-IV",
    "CSF;SPINAL FLUID", "PLEURAL FLUID", "PERITONEAL FLUID",
]
ORGANISMS_OF_INTEREST = [
    "STAPHYLOCOCCUS AUREUS", "STAPHYLOCOCCUS, COAGULASE NEGATIVE", "KLEBSIELLA PNEUMONIAE",
    "ESCHERICHIA COLI", "PSEUDOMONAS AERUGINOSA", "ENTEROCOCCUS SP.", "CANDIDA ALBICANS",
    "ACINETOBACTER BAUMANNII", "ENTEROBACTER CLOACAE", "STREPTOCOCCUS PNEUMONIAE",
]
# Fixed values: (organism, antibiotic, result) per resistance marker.
RESISTANCE_MARKERS = {
    "mrsa": ("STAPHYLOCOCCUS AUREUS", "OXACILLIN", "R"),
    "vre": ("ENTEROCOCCUS SP.", "VANCOMYCIN", "R"),
    "esbl": ("KLEBSIELLA PNEUMONIAE", "CEFTRIAXONE", "R"),
    "cre": ("KLEBSIELLA PNEUMONIAE", "MEROPENEM", "R"),
}

# Columns whose NULL becomes the column median.
MEDIAN_IMPUTE = [
    "systolic_bp_min", "systolic_bp_avg", "systolic_bp_max",
    "diastolic_bp_min", "diastolic_bp_avg", "diastolic_bp_max",
    "heart_rate_min", "heart_rate_avg", "heart_rate_max",
    "respiratory_rate_min", "respiratory_rate_avg", "respiratory_rate_max",
    "temperature_min", "temperature_avg", "temperature_max",
    "spo2_min", "spo2_avg", "spo2_max",
    "fio2_avg", "peep_min", "peep_avg", "peep_max",
    "minute_volume_min", "minute_volume_avg", "minute_volume_max",
    "tidal_volume_min", "tidal_volume_avg", "tidal_volume_max",
    "weight_min", "weight_avg", "weight_max",
    "pain_score_min", "pain_score_avg", "pain_score_max",
    "gcs_verbal_min", "gcs_verbal_avg", "gcs_verbal_max",
    "gcs_eye_min", "gcs_eye_avg", "gcs_eye_max",
    "gcs_motor_min", "gcs_motor_avg", "gcs_motor_max",
    "gcs_total_min", "gcs_total_avg", "gcs_total_max",
    "ph_blood_latest", "hematocrit_latest", "hemoglobin_latest",
    "bun_latest", "bicarbonate_latest", "bilirubin_total_latest",
    "calcium_latest", "albumin_latest", "ptt_latest",
    "creatinine_latest", "pt_latest", "po2_latest",
    "glucose_lab_latest", "platelets_latest", "magnesium_latest",
    "lactate_latest", "o2_sat_blood_latest", "chloride_latest",
    "potassium_latest", "pco2_latest", "urine_protein_latest",
    "troponin_latest", "alt_latest", "wbc_latest",
    "total_protein_latest", "urine_creatinine_latest",
    "lipase_latest", "glucose_bedside_avg", "glucose_bedside_max",
]

# Columns whose NULL becomes zero.
ZERO_IMPUTE = [
    "d5w_sum", "midazolam_sum", "propofol_sum",
    "phenylephrine_sum", "vasopressin_sum", "epinephrine_sum",
    "morphine_sum", "ffp_sum", "furosemide_sum",
    "heparin_sum", "milrinone_sum", "kcl_sum",
    "dexmedetomidine_sum", "prbc_sum", "dobutamine_sum",
    "tpn_sum", "cisatracurium_sum", "dopamine_sum",
    "lorazepam_sum", "hydromorphone_sum",
    "cryoprecipitate_sum", "metronidazole_sum",
    "piperacillin_tazo_sum", "sodium_bicarbonate_sum",
    "vancomycin_sum", "fentanyl_sum", "platelets_sum",
    "d5w_count", "propofol_count", "midazolam_count",
    "fentanyl_count", "epinephrine_count", "phenylephrine_count",
    "heparin_count", "vasopressin_count", "dopamine_count",
    "furosemide_count", "kcl_count", "cisatracurium_count",
    "milrinone_count", "ffp_count", "prbc_count", "tpn_count",
    "dobutamine_count", "morphine_count", "albumin_5_count",
    "lorazepam_count", "hydromorphone_count",
    "piperacillin_tazo_count", "sodium_bicarbonate_count",
    "metronidazole_count", "platelets_count", "vancomycin_count",
    "urine_foley_count", "urine_total_sum", "urine_total_count",
    "gastric_tube_sum", "urine_void_count", "stool_sum",
    "drain_sum", "chest_tube_count", "urine_void_sum",
    "chest_tube_sum", "drain_count", "emesis_sum",
    "gastric_tube_count", "stool_count",
    "arterial_line_num", "icp_line_num", "picc_line_num",
    "trauma_line_num", "dialysis_catheter_num",
    "icp_line_had", "arterial_line_had", "picc_line_had",
    "trauma_line_had", "dialysis_catheter_had",
]

# Columns left as they are, and columns that never reach a model.
DO_NOT_IMPUTE = ["EXPIRE_FLAG"]
NOT_FEATURES = ["LOS", "ICUSTAY_ID", "SUBJECT_ID", "DOB", "ADMITTIME", "INTIME", "END_FIRST_24H"]
CATEGORICAL_FEATURES = ["GENDER", "ADMISSION_TYPE", "FIRST_CAREUNIT", "DIAGNOSIS"]
