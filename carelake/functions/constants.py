"""Fixed values that results must equal.

Everything in this module is a FIXED VALUE: word lists, lookup tables and
limits that the clinical rules are defined by. They are stated as plain text
in their natural order. Code elsewhere turns them into literal Spark arrays,
maps or tiny DataFrames; nothing here runs Spark.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: clean-stage limits and required encounter columns
# ---------------------------------------------------------------------------
REQUIRED_COLUMNS = ["Age", "Gender", "Symptoms", "Diagnosis"]
AGE_MIN, AGE_MAX = 0, 120

# Gender spellings replaced after title case (whole value).
GENDER_REPLACE = {
    "M": "Male", "F": "Female", "Masculino": "Male", "Femenino": "Female", "Otro": "Other",
}

# Age bins: (label, exclusive upper bound); the last bin is open.
AGE_BINS = [("0-17", 18), ("18-34", 35), ("35-54", 55), ("55-74", 75), ("75+", None)]

# Null tokens of the pandas CSV reader (ETL path only, see README K2).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: symptom translation, Spanish and Catalan to English.
# Entries in dictionary order; a repeated key keeps its first position.
# ---------------------------------------------------------------------------
SYMPTOM_MAP_ENTRIES = [
    ("dolor de cabeza", "headache"),
    ("dolor de pecho", "chest pain"),
    ("dolor pecho", "chest pain"),
    ("dolor abdominal", "abdominal pain"),
    ("dolor de estomago", "abdominal pain"),
    ("dolor estomago", "abdominal pain"),
    ("dolor de espalda", "back pain"),
    ("dolor muscular", "muscle pain"),
    ("dolor articular", "joint pain"),
    ("dolor de garganta", "sore throat"),
    ("dolor de huesos", "bone pain"),
    ("dificultad para respirar", "shortness of breath"),
    ("dificultad respiratoria", "shortness of breath"),
    ("falta de aire", "shortness of breath"),
    ("respiracion corta", "shortness of breath"),
    ("falta de oxigeno", "shortness of breath"),
    ("fatiga", "fatigue"),
    ("cansancio", "fatigue"),
    ("fiebre", "fever"),
    ("tos", "cough"),
    ("mareo", "dizziness"),
    ("nauseas", "nausea"),
    ("nausea", "nausea"),
    ("vomito", "vomiting"),
    ("vomitos", "vomiting"),
    ("diarrea", "diarrhea"),
    ("estreñimiento", "constipation"),
    ("estrenimiento", "constipation"),
    ("ictericia", "jaundice"),
    ("piel amarilla", "jaundice"),
    ("perdida de peso", "weight loss"),
    ("pérdida de peso", "weight loss"),
    ("miccion frecuente", "frequent urination"),
    ("orinar frecuente", "frequent urination"),
    ("micción frecuente", "frequent urination"),
    ("ganas de orinar", "frequent urination"),
    ("perdida de apetito", "loss of appetite"),
    ("falta de apetito", "loss of appetite"),
    ("sudoracion", "sweating"),
    ("sudoracion nocturna", "night sweats"),
    ("vision borrosa", "blurred vision"),
    ("visión borrosa", "blurred vision"),
    ("entumecimiento", "numbness"),
    ("hormigueo", "tingling"),
    ("debilidad", "weakness"),
    ("palpitaciones", "palpitations"),
    ("hinchazon", "swelling"),
    ("hinchazón", "swelling"),
    ("erupcion", "rash"),
    ("erupcion cutanea", "rash"),
    ("picazon", "itching"),
    ("picazón", "itching"),
    ("confusion", "confusion"),
    ("ansiedad", "anxiety"),
    ("depresion", "depression"),
    ("tristeza", "depression"),
    ("insomnio", "insomnia"),
    ("escalofrios", "chills"),
    ("escalofríos", "chills"),
    ("sed excesiva", "excessive thirst"),
    ("mucha sed", "excessive thirst"),
    ("hambre excesiva", "excessive hunger"),
    ("orina oscura", "dark urine"),
    ("heces oscuras", "dark stools"),
    ("sangre en orina", "blood in urine"),
    ("sangrado", "bleeding"),
    ("hemorragia", "hemorrhage"),
    ("convulsiones", "seizures"),
    ("paralisis", "paralysis"),
    ("pérdida de memoria", "memory loss"),
    ("perdida de memoria", "memory loss"),
    ("caida de cabello", "hair loss"),
    ("alopecia", "hair loss"),
    ("acne", "acne"),
    ("erupciones", "rashes"),
    ("temperatura alta", "fever"),
    ("escalofrio", "chills"),
    ("temblores", "tremors"),
    ("rigidez", "stiffness"),
    ("inflamacion", "inflammation"),
    ("inflamación", "inflammation"),
    ("febre", "fever"),
    ("mal de cap", "headache"),
    ("mal de gola", "sore throat"),
    ("dolor toracic", "chest pain"),
    ("dolor toràcic", "chest pain"),
    ("opressio toracica", "chest tightness"),
    ("opressió toràcica", "chest tightness"),
    ("dolor abdominal", "abdominal pain"),
    ("dolor articular", "joint pain"),
    ("dificultat per respirar", "shortness of breath"),
    ("mareig", "dizziness"),
    ("nausees", "nausea"),
    ("nàusees", "nausea"),
    ("inflor", "swelling"),
    ("perdua de pes", "weight loss"),
    ("pèrdua de pes", "weight loss"),
    ("miccio frequent", "frequent urination"),
    ("micció freqüent", "frequent urination"),
    ("set excessiva", "excessive thirst"),
    ("ictericia", "jaundice"),
    ("icterícia", "jaundice"),
    ("perdua d'interes", "loss of interest"),
    ("pèrdua d'interès", "loss of interest"),
    ("perdua del gust", "loss of taste"),
    ("pèrdua del gust", "loss of taste"),
    ("entumiment", "numbness"),
    ("tristesa", "sadness"),
    ("dificultat per parlar", "trouble speaking"),
    ("xiulets al pit", "wheezing"),
    ("visio borrosa", "blurred vision"),
    ("visió borrosa", "blurred vision"),
    ("dolors musculars", "body aches"),
    ("congestio nasal", "runny nose"),
    ("congestió nasal", "runny nose"),
    ("confusio", "confusion"),
    ("confusió", "confusion"),
    ("fatiga", "fatigue"),
    ("tos", "cough"),
    ("body aches", "body aches"),
    ("runny nose", "runny nose"),
    ("sadness", "sadness"),
    ("loss of interest", "loss of interest"),
    ("loss of taste", "loss of taste"),
    ("chest tightness", "chest tightness"),
    ("wheezing", "wheezing"),
    ("trouble speaking", "trouble speaking"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: diagnosis to hospital zone and mapped doctor
# ---------------------------------------------------------------------------
DIAGNOSIS_ASSIGNMENTS = [
    ("Heart Disease", "Cardiologia", "Dr. Andres Morales (Cardiologo)"),
    ("Hypertension", "Cardiologia", "Dra. Laura Castillo (Cardiologa)"),
    ("Stroke", "Neurologia", "Dr. Javier Rojas (Neurologo)"),
    ("Asthma", "Neumologia", "Dra. Sofia Ibanez (Neumologa)"),
    ("COVID-19", "Infectologia", "Dr. Miguel Torres (Infectologo)"),
    ("Diabetes", "Endocrinologia", "Dra. Daniela Paredes (Endocrina)"),
    ("Kidney Disease", "Nefrologia", "Dr. Ricardo Mendez (Nefrologo)"),
    ("Liver Disease", "Hepatologia", "Dra. Paula Jimenez (Hepatologa)"),
    ("Cancer", "Oncologia", "Dr. Sebastian Vega (Oncologo)"),
    ("Depression", "Salud Mental", "Dra. Valeria Nunez (Psiquiatra)"),
    ("Pneumonia", "Neumologia", "Dr. Hector Salazar (Neumologo)"),
    ("Bronchitis", "Neumologia", "Dra. Sofia Ibanez (Neumologa)"),
    ("Migraine", "Neurologia", "Dr. Julio Fernandez (Neurologo)"),
    ("Anxiety Disorder", "Salud Mental", "Dra. Beatriz Ortega (Psicologa)"),
    ("Arthritis", "Reumatologia", "Dra. Carolina Lopez (Reumatologa)"),
    ("Osteoporosis", "Traumatologia", "Dr. Alberto Ramos (Traumatologo)"),
    ("Dermatitis", "Dermatologia", "Dra. Marta Solis (Dermatologa)"),
    ("Gastroenteritis", "Gastroenterologia", "Dr. Joaquin Pereira (Gastroenterologo)"),
    ("Anemia", "Hematologia", "Dra. Elena Cabrera (Hematologa)"),
    ("Thyroid Disorder", "Endocrinologia", "Dra. Daniela Paredes (Endocrina)"),
]

# FIXED VALUES: keyword zones for unmapped diagnoses, first group with a hit wins.
KEYWORD_ZONES = [
    (("heart", "cardiac", "hyperten", "tachy", "arrhyth"), "Cardiologia"),
    (("stroke", "migraine", "neuro", "epilep", "alzheimer", "parkinson"), "Neurologia"),
    (("asthma", "pneumon", "bronch", "copd", "lung", "respirat"), "Neumologia"),
    (("covid", "infect", "sepsis", "tuberc", "hepatitis"), "Infectologia"),
    (("diabet", "thyroid", "endocrine", "hormone"), "Endocrinologia"),
    (("kidney", "renal", "nephr"), "Nefrologia"),
    (("liver", "hepat", "cirrhos"), "Hepatologia"),
    (("cancer", "tumor", "neoplas", "leukem", "lymphom", "melanom"), "Oncologia"),
    (("depress", "anxiety", "psych", "bipolar", "schizo", "panic"), "Salud Mental"),
    (("arthrit", "lupus", "reumat"), "Reumatologia"),
    (("osteopor", "fracture", "trauma", "orthoped"), "Traumatologia"),
    (("derma", "skin", "eczema", "psoria", "acne", "rash"), "Dermatologia"),
    (("gastr", "colitis", "ulcer", "ibs", "crohn"), "Gastroenterologia"),
    (("anemia", "leukem", "blood", "thrombo", "hemato"), "Hematologia"),
]
DEFAULT_ZONE = "Medicina General"
DUTY_DOCTOR = "Dr. Equipo de Guardia"

# FIXED VALUES: default doctor roster (name, specialty, zone, email, phone, shift);
# ids are positions from 1, all active.
DEFAULT_DOCTOR_ROSTER = [
    ("Dr. Andres Morales", "Cardiologia", "Cardiologia", "andres.morales@hospital.com", "+34 600 100 100", "Manana"),
    ("Dra. Laura Castillo", "Cardiologia", "Cardiologia", "laura.castillo@hospital.com", "+34 600 100 101", "Tarde"),
    ("Dr. Javier Rojas", "Neurologia", "Neurologia", "javier.rojas@hospital.com", "+34 600 100 102", "Noche"),
    ("Dra. Sofia Ibanez", "Neumologia", "Neumologia", "sofia.ibanez@hospital.com", "+34 600 100 103", "Manana"),
    ("Dr. Miguel Torres", "Infectologia", "Infectologia", "miguel.torres@hospital.com", "+34 600 100 104", "Tarde"),
    ("Dra. Daniela Paredes", "Endocrinologia", "Endocrinologia", "daniela.paredes@hospital.com", "+34 600 100 105", "Manana"),
    ("Dr. Ricardo Mendez", "Nefrologia", "Nefrologia", "ricardo.mendez@hospital.com", "+34 600 100 106", "Tarde"),
    ("Dra. Paula Jimenez", "Hepatologia", "Hepatologia", "paula.jimenez@hospital.com", "+34 600 100 107", "Manana"),
    ("Dr. Sebastian Vega", "Oncologia", "Oncologia", "sebastian.vega@hospital.com", "+34 600 100 108", "Tarde"),
    ("Dra. Valeria Nunez", "Salud Mental", "Salud Mental", "valeria.nunez@hospital.com", "+34 600 100 109", "Manana"),
    ("Dr. Hector Salazar", "Neumologia", "Neumologia", "hector.salazar@hospital.com", "+34 600 100 110", "Noche"),
    ("Dra. Carolina Lopez", "Reumatologia", "Reumatologia", "carolina.lopez@hospital.com", "+34 600 100 111", "Manana"),
    ("Dr. Alberto Ramos", "Traumatologia", "Traumatologia", "alberto.ramos@hospital.com", "+34 600 100 112", "Tarde"),
    ("Dra. Marta Solis", "Dermatologia", "Dermatologia", "marta.solis@hospital.com", "+34 600 100 113", "Manana"),
    ("Dr. Joaquin Pereira", "Gastroenterologia", "Gastroenterologia", "joaquin.pereira@hospital.com", "+34 600 100 114", "Tarde"),
    ("Dra. Elena Cabrera", "Hematologia", "Hematologia", "elena.cabrera@hospital.com", "+34 600 100 115", "Manana"),
    ("Dra. Beatriz Ortega", "Salud Mental", "Salud Mental", "beatriz.ortega@hospital.com", "+34 600 100 116", "Tarde"),
    ("Dr. Julio Fernandez", "Neurologia", "Neurologia", "julio.fernandez@hospital.com", "+34 600 100 117", "Manana"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: model rules
# ---------------------------------------------------------------------------
HIGH_RISK_DIAGNOSES = ["Cancer", "Heart Disease", "Stroke"]
MEDIUM_RISK_DIAGNOSES = ["Diabetes", "Kidney Disease", "Liver Disease", "COVID-19", "Hypertension"]
RISK_CLASSES = ["Low", "Medium", "High"]

# Classes of the published trained disease model (alphabetical).
KNOWN_DISEASE_CLASSES = [
    "Asthma", "COVID-19", "Cancer", "Depression", "Diabetes",
    "Heart Disease", "Hypertension", "Kidney Disease", "Liver Disease", "Stroke",
]

RISK_RECOMMENDATIONS = {
    "Low": [
        "Monitoreo rutinario cada 6 meses.",
        "Mantener habitos saludables y actividad fisica.",
        "Revision anual de signos vitales.",
    ],
    "Medium": [
        "Seguimiento medico cada 2-3 meses.",
        "Analisis de laboratorio completo.",
        "Evaluar ajustes de medicacion.",
        "Dieta y ejercicio supervisados.",
    ],
    "High": [
        "Atencion medica urgente.",
        "Hospitalizacion o monitoreo intensivo.",
        "Consulta con especialista.",
        "Revision diaria de signos vitales.",
    ],
}

SYMPTOM_KEEP_PROB = 0.65
LABEL_NOISE_PCT = 0.05
SEED = 42

# ---------------------------------------------------------------------------
# FIXED VALUES: X-ray classes, alert rule, image files
# ---------------------------------------------------------------------------
XRAY_CLASSES = ["normal", "pneumonia", "covid"]
XRAY_CLASS_LABELS = {"normal": "Sana", "pneumonia": "Neumonía", "covid": "COVID-19"}
ALERT_THRESHOLD = 0.60
ALERT_MESSAGE_COVID = (
    "ALERTA: Posible COVID-19 detectado ({pct} confianza). "
    "Aislar al paciente y confirmar con PCR. "
    "Un falso negativo en COVID implica riesgo de contagio masivo."
)
ALERT_MESSAGE_PNEUMONIA = (
    "ALERTA: Posible Neumonía detectada ({pct} confianza). "
    "Evaluar tratamiento antibiótico/antiviral urgente. "
    "Un falso negativo puede derivar en sepsis."
)
TRAIN_IMAGE_EXTS = [".jpg", ".jpeg", ".png", ".webp", ".bmp"]
UPLOAD_IMAGE_EXTS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif", ".dcm", ".dic"]
LEAF_NAME_MAX = 240
COVID_TRAIN_OVERSAMPLE = 40
MIN_TRAIN_IMAGES, MIN_TEST_IMAGES = 30, 10

# Study category synonyms.
DENTAL_SYNONYMS = ["dental", "dentist", "odontologia", "diente", "teeth"]
GENERAL_SYNONYMS = ["general", "radiology", "radiografia", "rx", "bodily", "hospital"]

# ---------------------------------------------------------------------------
# FIXED VALUES: notifications
# ---------------------------------------------------------------------------
NOTIFICATION_LEVELS = ["info", "success", "warning", "error"]
NOTIF_TITLE_MAX, NOTIF_MESSAGE_MAX, NOTIF_SOURCE_MAX, NOTIF_META_MAX = 240, 4000, 80, 2000

# ---------------------------------------------------------------------------
# FIXED VALUES: display labels (kind, language) -> key -> label.
# English is the key itself for diagnoses, symptoms, risk and gender.
# ---------------------------------------------------------------------------
LABELS_DX = {
    "es": {
        "Heart Disease": "Enfermedad cardiaca", "Hypertension": "Hipertension", "Stroke": "Ictus",
        "Asthma": "Asma", "COVID-19": "COVID-19", "Diabetes": "Diabetes",
        "Kidney Disease": "Enfermedad renal", "Liver Disease": "Enfermedad hepatica",
        "Cancer": "Cancer", "Depression": "Depresion", "Pneumonia": "Neumonia",
        "Bronchitis": "Bronquitis", "Migraine": "Migrana", "Anxiety Disorder": "Trastorno de ansiedad",
        "Arthritis": "Artritis", "Osteoporosis": "Osteoporosis", "Dermatitis": "Dermatitis",
        "Gastroenteritis": "Gastroenteritis", "Anemia": "Anemia",
        "Thyroid Disorder": "Trastorno tiroideo", "Unknown": "Desconocido",
    },
    "ca": {
        "Heart Disease": "Malaltia cardiaca", "Hypertension": "Hipertensio", "Stroke": "Ictus",
        "Asthma": "Asma", "COVID-19": "COVID-19", "Diabetes": "Diabetis",
        "Kidney Disease": "Malaltia renal", "Liver Disease": "Malaltia hepatica",
        "Cancer": "Cancer", "Depression": "Depressio", "Pneumonia": "Pneumonia",
        "Bronchitis": "Bronquitis", "Migraine": "Migranya", "Anxiety Disorder": "Trastorn d'ansietat",
        "Arthritis": "Artritis", "Osteoporosis": "Osteoporosi", "Dermatitis": "Dermatitis",
        "Gastroenteritis": "Gastroenteritis", "Anemia": "Anemia",
        "Thyroid Disorder": "Trastorn tiroidal", "Unknown": "Desconegut",
    },
}
LABELS_SYM = {
    "es": {
        "fever": "fiebre", "cough": "tos", "fatigue": "fatiga",
        "headache": "dolor de cabeza", "shortness of breath": "dificultad para respirar",
        "chest pain": "dolor toracico", "chest tightness": "opresion toracica",
        "nausea": "nauseas", "dizziness": "mareo", "sore throat": "dolor de garganta",
        "body aches": "dolores musculares", "runny nose": "congestion nasal",
        "weight loss": "perdida de peso", "joint pain": "dolor articular",
        "abdominal pain": "dolor abdominal", "swelling": "hinchazon",
        "blurred vision": "vision borrosa", "confusion": "confusion",
        "frequent urination": "miccion frecuente", "increased thirst": "sed excesiva",
        "jaundice": "ictericia", "loss of interest": "perdida de interes",
        "loss of taste": "perdida del gusto", "numbness": "entumecimiento",
        "pain": "dolor", "sadness": "tristeza",
        "trouble speaking": "dificultad al hablar", "wheezing": "sibilancias",
    },
    "ca": {
        "fever": "febre", "cough": "tos", "fatigue": "fatiga",
        "headache": "mal de cap", "shortness of breath": "dificultat per respirar",
        "chest pain": "dolor toracic", "chest tightness": "opressio toracica",
        "nausea": "nausees", "dizziness": "mareig", "sore throat": "mal de gola",
        "body aches": "dolors musculars", "runny nose": "congestio nasal",
        "weight loss": "perdua de pes", "joint pain": "dolor articular",
        "abdominal pain": "dolor abdominal", "swelling": "inflor",
        "blurred vision": "visio borrosa", "confusion": "confusio",
        "frequent urination": "miccio frequent", "increased thirst": "set excessiva",
        "jaundice": "ictericia", "loss of interest": "perdua d'interes",
        "loss of taste": "perdua del gust", "numbness": "entumiment",
        "pain": "dolor", "sadness": "tristesa",
        "trouble speaking": "dificultat per parlar", "wheezing": "xiulets al pit",
    },
}
LABELS_ZONE = {
    "es": {
        "Cardiologia": "Cardiologia", "Neurologia": "Neurologia",
        "Neumologia": "Neumologia", "Infectologia": "Infectologia",
        "Endocrinologia": "Endocrinologia", "Nefrologia": "Nefrologia",
        "Hepatologia": "Hepatologia", "Oncologia": "Oncologia",
        "Salud Mental": "Salud Mental", "Medicina General": "Medicina General",
        "Reumatologia": "Reumatologia", "Traumatologia": "Traumatologia",
        "Dermatologia": "Dermatologia", "Gastroenterologia": "Gastroenterologia",
        "Hematologia": "Hematologia",
    },
    "en": {
        "Cardiologia": "Cardiology", "Neurologia": "Neurology",
        "Neumologia": "Pulmonology", "Infectologia": "Infectious Diseases",
        "Endocrinologia": "Endocrinology", "Nefrologia": "Nephrology",
        "Hepatologia": "Hepatology", "Oncologia": "Oncology",
        "Salud Mental": "Mental Health", "Medicina General": "General Medicine",
        "Reumatologia": "Rheumatology", "Traumatologia": "Orthopedics",
        "Dermatologia": "Dermatology", "Gastroenterologia": "Gastroenterology",
        "Hematologia": "Hematology",
    },
    "ca": {
        "Cardiologia": "Cardiologia", "Neurologia": "Neurologia",
        "Neumologia": "Pneumologia", "Infectologia": "Infectologia",
        "Endocrinologia": "Endocrinologia", "Nefrologia": "Nefrologia",
        "Hepatologia": "Hepatologia", "Oncologia": "Oncologia",
        "Salud Mental": "Salut Mental", "Medicina General": "Medicina General",
        "Reumatologia": "Reumatologia", "Traumatologia": "Traumatologia",
        "Dermatologia": "Dermatologia", "Gastroenterologia": "Gastroenterologia",
        "Hematologia": "Hematologia",
    },
}
LABELS_RISK = {
    "es": {"Low": "Bajo", "Medium": "Medio", "High": "Alto"},
    "ca": {"Low": "Baix", "Medium": "Mitja", "High": "Alt"},
}
LABELS_GENDER = {
    "es": {"Male": "Masculino", "Female": "Femenino", "Other": "Otro"},
    "ca": {"Male": "Home", "Female": "Dona", "Other": "Altre"},
}
LABEL_LANGS = ["es", "en", "ca"]
DEFAULT_LABEL_LANG = "es"


def symptom_map_unique() -> list[tuple[str, str]]:
    """Dictionary semantics: first position of a key, last value written."""
    order: list[str] = []
    vals: dict[str, str] = {}
    for k, v in SYMPTOM_MAP_ENTRIES:
        if k not in vals:
            order.append(k)
        vals[k] = v
    return [(k, vals[k]) for k in order]


def symptom_map_by_length() -> list[tuple[str, str]]:
    """Keys longest first; equal lengths keep dictionary order (stable sort)."""
    return sorted(symptom_map_unique(), key=lambda kv: len(kv[0]), reverse=True)


def label_table(kind: str) -> dict[str, dict[str, str]]:
    """Full (lang -> key -> label) table of one kind, English included."""
    src = {"diagnosis": LABELS_DX, "symptom": LABELS_SYM, "zone": LABELS_ZONE,
           "risk": LABELS_RISK, "gender": LABELS_GENDER}[kind]
    out = {lang: dict(tbl) for lang, tbl in src.items()}
    if "en" not in out:
        out["en"] = {k: k for k in out["es"]}
    return out
