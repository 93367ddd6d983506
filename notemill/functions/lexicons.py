"""Default lexicons. All are data that a caller may replace."""

from __future__ import annotations

CATEGORIES = ("disease_or_syndrome", "sign_or_symptom", "pharmacologic_substance", "laboratory_or_test_result", "diagnostic_procedure", "organism_or_virus")

# --- fixed values: section headers and what may follow them ---
SECTIONS = {
    "complaint": ("Chief Complaint:", ("Major Surgical", "History of Present Illness:")),
    "hpi": ("History of Present Illness:", ("Past Medical History:", "Review of Systems:", "Physical Exam:")),
    "diagnosis": ("Discharge Diagnosis:", ("Discharge Condition:", "Discharge Instructions:", "Medications", "Followup")),
    "exam": ("Physical Exam:", ("Pertinent Results:", "Brief Hospital Course:", "Discharge:")),
    "admission_meds": ("Medications on Admission:", ("Discharge Medications:", "Discharge Disposition:")),
    "exam_context": ("Physical Exam:", ("Brief Hospital Course:", "Pertinent Results:", "Medications")),
    "admission_context": ("Medications on Admission:", ("Discharge Medications:", "Discharge Diagnosis:", "Physical Exam:")),
    "past_history": ("Past Medical History:", ("Social History:", "Family History:", "Physical Exam:")),
}

# --- fixed values: symptom patterns ---
SYMPTOMS = {
    "fever": r"fever|febrile|elevated temperature|chills|rigor",
    "headache": r"headache",
    "myalgia": r"myalgia|muscle pain|body aches",
    "arthralgia": r"arthralgia|joint pain",
    "rash": r"rash|erythema|exanthem|maculopapular",
    "fatigue": r"fatigue|malaise|lethargy",
    "nausea": r"nausea|vomiting|emesis",
}

# --- fixed values: disease labels on the diagnosis section ---
LABELS = {
    "Aids": r"\b(hiv|aids|acquired immunodeficiency syndrome|human immunodeficiency virus)\b",
    "Hepatites Virais": r"\b(hepatitis [abc]|hep[- ]?[abc]|hav|hbv|hcv)\b",
    "Tuberculose": r"\b(tuberculosis|mycobacterium tuberculosis|pulmonary tb|tb)\b",
    "Meningite": r"\b(meningitis|meningococcal disease|neisseria meningitidis|bacterial meningitis|viral meningitis)\b",
    "Sifilis": r"\b(syphilis|congenital syphilis|treponema pallidum|neurosyphilis)\b",
    "Sarampo": r"\b(measles|rubeola)\b",
    "Coqueluche": r"\b(pertussis|whooping cough|bordetella pertussis|b\.? pertussis)\b",
    "Malaria": r"\b(malaria|plasmodium falciparum|plasmodium vivax)\b",
    "Arboviroses (Deng/Zik/Chik)": r"\b(dengue|dengue hemorrhagic fever|zika virus|zikv|chikungunya|chikv)\b",
    "Doenca de Chagas": r"\b(chagas disease|trypanosoma cruzi|chagasic cardiomyopathy|megacolon)\b",
    "Leptospirose": r"\b(leptospirosis|weil\'s disease|leptospira)\b",
    "Febre Amarela": r"\b(yellow fever)\b",
    "Febre Tifoide": r"\b(typhoid fever|salmonella typhi)\b",
    "Hanseniase": r"\b(leprosy|hansen\'s disease)\b",
    "Leishmaniose": r"\b(leishmaniasis|cutaneous leishmaniasis)\b",
    "Raiva Humana": r"\b(rabies|rabies pep|rabies vaccine)\b",
}

# --- fixed values: context and laboratory features ---
TRAVEL = r"\b(travel|traveled|trip|visited|immigrant|endemic|tropics)\b"
ANTIPYRETIC = r"\b(acetaminophen|tylenol|ibuprofen|motrin|advil|aspirin)\b"
ANTIMALARIAL = r"\b(malarone|chloroquine|mefloquine|atovaquone|doxycycline)\b"
TEMPERATURE = r"(?:T|Temp)\s*[:=]?\s*([9][0-9]\.[0-9]|10[0-9]\.[0-9])"
DIABETES = r"\b(diabetes|dm2|dm1|diabetic)\b"
HYPERTENSION = r"\b(hypertension|htn|high blood pressure)\b"
PLATELETS = r"\b(thrombocytopenia|low platelets|plts\s*(?:were|<|:|=|)?\s*\d{1,3})\b"
NEGATORS = ("no", "not", "denies", "denied", "negative", "without")
NEGATED_TERMS = ("fever", "fevers", "febrile", "chills")

# --- fixed values: mentions of a cohort's target, and names of targets ---
MENTIONS = {
    "HIV": r"\b(hiv|aids|human immunodeficiency|cd4|antiretroviral|haart|\bart\b|truvada|ritonavir|darunavir|raltegravir|dolutegravir|tenofovir|emtricitabine|abacavir|lamivudine|efavirenz|nevirapine|atazanavir|lopinavir|elvitegravir|biktarvy)\b",
    "Tuberculose": r"\b(tuberculosis|tuberculous|\btb\b|mycobacterium|ppd|igra|quantiferon|afb|isoniazid|rifampin|rifampicin|ethambutol|pyrazinamide|\binh\b|\brip\b|\bmtb\b|mantoux|ghon)\b",
    "Sifilis": r"\b(syphilis|treponema|rpr|vdrl|fta-abs|penicillin g benzathine|neurosyphilis|chancre|gumma|treponemal|nontreponemal)\b",
}
ALIASES = {"hiv": "HIV", "tuberculose": "Tuberculose", "tuberculosis": "Tuberculose", "sifilis": "Sifilis", "syphilis": "Sifilis"}

# --- fixed values: what makes a note complex ---
COMPLEXITY = {
    "negations": r"\b(negative|negativ[oe]|ruled out|no evidence|no history|denies|not detected|non-reactive|no growth|sem crescimento)\b",
    "pending": r"\b(pending|pnd|indeterminate|to be determined|awaiting)\b",
    "differentials": r"\b(differential diagnosis|ddx|rule out|r/o|consider|suspected|possible|probable|cannot exclude)\b",
    "medications": r"\b(mg|mcg|units|tablet|capsule|oral|iv|inhaler|daily|bid|tid|qid|prn|q\d+h)\b",
    "haart": r"\b(haart|antiretroviral|art regimen|truvada|biktarvy|ritonavir|darunavir|dolutegravir|raltegravir|tenofovir|emtricitabine|abacavir|lamivudine|efavirenz|atazanavir|lopinavir|elvitegravir|nevirapine)\b",
    "tb_tests": r"\b(quantiferon|ppd|igra|afb|acid.fast|mantoux|sputum.*culture|bam.*culture|mycobacterium.*culture)\b",
}

# --- fixed values: cleanup of entity lists ---
PRECEDENCE_A = ("laboratory_or_test_result", "organism_or_virus", "diagnostic_procedure", "disease_or_syndrome", "sign_or_symptom", "pharmacologic_substance")
PRECEDENCE_B = ("organism_or_virus", "pharmacologic_substance", "laboratory_or_test_result", "diagnostic_procedure", "disease_or_syndrome", "sign_or_symptom")
STOP_TERMS = ("paciente", "exame", "teste", "resultado", "tratamento", "terapia", "consulta", "acompanhamento")
IMAGING = (
    "derrame pleural", "derrame pericardico", "consolidacao", "consolidacoes", "opacidade", "opacidades", "vidro fosco", "vidro-fosco", "atelectasia", "atelectasias",
    "nodulo pulmonar", "nodulos pulmonares", "cavitacao", "cavitacoes", "massa pulmonar", "massa cerebelar", "massa cerebral", "espessamento pleural", "espessamento da parede",
    "espessamento parietal", "infiltrado", "infiltrados", "infiltrado intersticial", "cardiomegalia", "hipertransparencia", "pneumotorax", "efusao", "edema cerebral",
    "edema vasogenico", "desvio de linha media", "efeito de massa", "hidrocefalia", "ventriculomegalia", "hernia uncal", "herniacao", "dilatacao biliar",
    "dilatacao do ducto biliar comum", "esteatose hepatica", "esplenomegalia", "hepatomegalia", "hepatoesplenomegalia", "espessamento da parede retal",
    "espessamento parietal intestinal", "linfadenopatia", "linfadenomegalia", "linfonodos aumentados", "linfonodos calcificados", "linfonodo hilar",
    "linfonodos mediastinais", "nodulos tireoidianos", "lesao", "lesoes", "nodulo", "nodulos",
)
VITALS = r"^(spo2|sao2|sat(?:uracao)?\s+de\s+o2|saturacao|pa\b|pressao arterial|pressao sistolica|pressao diastolica|fc\b|frequencia cardiaca|pulso\b|fr\b|frequencia respiratoria|temperatura|t\s|tax\b|t°|pam\b|pressao arterial media|oximetria)"
TRANSLATIONS = {
    "rash": "exantema", "shortness of breath": "dispneia", "wheezing": "sibilos", "numbness": "dormência", "tightness": "opressão", "lightheadedness": "tontura",
    "swelling": "edema", "tenderness": "sensibilidade à palpação", "bruising": "equimose", "itching": "prurido", "clubbing": "baqueteamento digital", "cyanosis": "cianose",
    "altered mental status": "alteração do estado mental", "unresponsive": "não responsivo", "lethargic": "letárgico", "tender": "doloroso", "non-tender": "indolor",
    "soft": "macio", "fever": "febre", "cough": "tosse", "chest pain": "dor torácica", "nausea": "náusea", "vomiting": "vômito", "diarrhea": "diarreia", "headache": "cefaleia",
    "fatigue": "fadiga", "weakness": "fraqueza", "weight loss": "perda de peso", "night sweats": "sudorese noturna", "chills": "calafrios", "abdominal pain": "dor abdominal",
    "back pain": "dor lombar", "joint pain": "dor articular", "muscle pain": "mialgia", "sore throat": "dor de garganta", "runny nose": "rinorreia",
}
#: Folded spellings and the canonical names that they stand for.
CANONICAL = {
    "hipertensao": "Hipertensão arterial sistêmica",
    "hipertensao arterial": "Hipertensão arterial sistêmica",
    "hipertensao arterial sistemica": "Hipertensão arterial sistêmica",
    "has": "Hipertensão arterial sistêmica",
    "htn": "Hipertensão arterial sistêmica",
    "hypertension": "Hipertensão arterial sistêmica",
    "diabetes": "Diabetes Mellitus",
    "diabetes mellitus": "Diabetes Mellitus",
    "dm": "Diabetes Mellitus",
    "diabetes mellitus tipo 2": "Diabetes Mellitus tipo 2",
    "dm2": "Diabetes Mellitus tipo 2",
    "diabetes tipo 2": "Diabetes Mellitus tipo 2",
    "diabetes mellitus tipo 1": "Diabetes Mellitus tipo 1",
    "dm1": "Diabetes Mellitus tipo 1",
    "hiperlipidemia": "Dislipidemia",
    "dislipidemia": "Dislipidemia",
    "hyperlipidemia": "Dislipidemia",
    "drge": "Doença do Refluxo Gastroesofágico (DRGE)",
    "doenca do refluxo gastroesofagico": "Doença do Refluxo Gastroesofágico (DRGE)",
    "refluxo gastroesofagico": "Doença do Refluxo Gastroesofágico (DRGE)",
    "gerd": "Doença do Refluxo Gastroesofágico (DRGE)",
    "aids": "AIDS (Síndrome da Imunodeficiência Adquirida)",
    "sindrome da imunodeficiencia adquirida": "AIDS (Síndrome da Imunodeficiência Adquirida)",
    "hiv/aids": "HIV/AIDS",
    "hiv": "HIV/AIDS",
    "tuberculose": "Tuberculose",
    "tb": "Tuberculose",
    "tuberculose pulmonar": "Tuberculose pulmonar",
    "sifilis": "Sífilis",
    "syphilis": "Sífilis",
    "neurossifilis": "Neurossífilis",
    "neurosyphilis": "Neurossífilis",
    "insuficiencia renal cronica": "Doença renal crônica",
    "irc": "Doença renal crônica",
    "doenca renal cronica": "Doença renal crônica",
    "drc": "Doença renal crônica",
    "ckd": "Doença renal crônica",
    "insuficiencia renal aguda": "Lesão renal aguda",
    "ira": "Lesão renal aguda",
    "lesao renal aguda": "Lesão renal aguda",
    "insuficiencia cardiaca": "Insuficiência cardíaca",
    "insuficiencia cardiaca congestiva": "Insuficiência cardíaca congestiva",
    "icc": "Insuficiência cardíaca congestiva",
    "chf": "Insuficiência cardíaca congestiva",
    "fibrilacao atrial": "Fibrilação atrial",
    "fa": "Fibrilação atrial",
    "afib": "Fibrilação atrial",
    "dpoc": "Doença Pulmonar Obstrutiva Crônica (DPOC)",
    "doenca pulmonar obstrutiva cronica": "Doença Pulmonar Obstrutiva Crônica (DPOC)",
    "copd": "Doença Pulmonar Obstrutiva Crônica (DPOC)",
    "sindrome de raynaud": "Fenômeno de Raynaud",
    "fenomeno de raynaud": "Fenômeno de Raynaud",
    "doenca de raynaud": "Fenômeno de Raynaud",
    "anemia": "Anemia",
    "anemia ferropriva": "Anemia ferropriva",
    "anemia de doenca cronica": "Anemia de doença crônica",
    "anemia de inflamacao cronica": "Anemia de doença crônica",
    "hepatite b": "Hepatite B",
    "hepatite c": "Hepatite C",
    "hepatite a": "Hepatite A",
    "embolia pulmonar": "Embolia pulmonar",
    "ep": "Embolia pulmonar",
    "tromboembolismo pulmonar": "Embolia pulmonar",
    "tep": "Embolia pulmonar",
    "pe": "Embolia pulmonar",
    "obesidade": "Obesidade",
    "obesidade morbida": "Obesidade mórbida",
    "hipotireoidismo": "Hipotireoidismo",
    "asma": "Asma",
    "osteoporose": "Osteoporose",
    "osteopenia": "Osteopenia",
    "gota": "Gota",
    "depressao": "Depressão",
    "ansiedade": "Transtorno de ansiedade",
    "bactrim": "Sulfametoxazol-Trimetoprima",
    "tmp-smx": "Sulfametoxazol-Trimetoprima",
    "sulfametoxazol-trimetoprima": "Sulfametoxazol-Trimetoprima",
    "cotrimoxazol": "Sulfametoxazol-Trimetoprima",
    "tylenol": "Paracetamol",
    "acetaminofeno": "Paracetamol",
    "paracetamol": "Paracetamol",
    "advil": "Ibuprofeno",
    "ibuprofeno": "Ibuprofeno",
    "lasix": "Furosemida",
    "furosemida": "Furosemida",
    "zofran": "Ondansetrona",
    "ondansetrona": "Ondansetrona",
    "heparina": "Heparina",
    "enoxaparina": "Enoxaparina",
    "lovenox": "Enoxaparina",
    "insulina": "Insulina",
    "insulina regular": "Insulina regular",
    "insulina nph": "Insulina NPH",
    "insulina glargina": "Insulina glargina",
    "lantus": "Insulina glargina",
    "mycobacterium tuberculosis": "Mycobacterium tuberculosis",
    "m. tuberculosis": "Mycobacterium tuberculosis",
    "mtb": "Mycobacterium tuberculosis",
    "pneumocystis jirovecii": "Pneumocystis jirovecii",
    "pneumocystis carinii": "Pneumocystis jirovecii",
    "pcp": "Pneumocystis jirovecii",
    "treponema pallidum": "Treponema pallidum",
    "virus da hepatite b": "Vírus da Hepatite B (HBV)",
    "hbv": "Vírus da Hepatite B (HBV)",
    "virus da hepatite b (hbv)": "Vírus da Hepatite B (HBV)",
    "virus da hepatite c": "Vírus da Hepatite C (HCV)",
    "hcv": "Vírus da Hepatite C (HCV)",
    "staphylococcus aureus": "Staphylococcus aureus",
    "s. aureus": "Staphylococcus aureus",
    "mrsa": "Staphylococcus aureus resistente à meticilina (MRSA)",
    "escherichia coli": "Escherichia coli",
    "e. coli": "Escherichia coli",
    "candida albicans": "Candida albicans",
    "c. albicans": "Candida albicans",
}

# --- fixed values: quality checks ---
CHECK_SYMPTOMS = (
    "febre", "tosse", "dispneia", "dor toracica", "dor abdominal", "nausea", "vomito", "diarreia", "cefaleia", "fadiga", "mal estar", "calafrios", "sudorese noturna", "perda de peso",
    "perda de apetite", "mialgia", "artralgia", "dor", "edema", "prurido", "rash", "tosse seca", "tosse produtiva", "hemoptise", "ortopneia", "dor toracica pleuritica", "aperto toracico",
    "dormencia", "parestesia", "fraqueza", "tontura", "sincope",
)
CHECK_IMAGING = ("atelectasia", "edema pulmonar", "derrame pleural", "derrame pericardico", "consolidacao", "opacidade", "infiltrado", "nodulo pulmonar", "linfonodo aumentado", "linfonodo hilar", "cicatrizacao biapical", "espessamento pleural", "pneumotorax", "cardiomegalia", "calcificacao", "efusao")
CHECK_VITALS = r"\b(spo2|sao2|saturacao de o2|oximetria|temperatura|pressao arterial|pa |fc |fr |frequencia cardiaca|frequencia respiratoria)\b"
CHECK_NEGATIVE = r"(negativ[oe]|negative|sem crescimento|no growth|not detected|nao detectado|nao reativ[oa]|non-reactive)"
CHECK_PENDING = r"(pendente|pending|pnd|indeterminad[oa]|indeterminate)"
CHECK_ENGLISH = r"\b(fever|cough|chest pain|shortness of breath|nausea|vomiting|diarrhea|headache|fatigue|weakness|numbness|tightness|weight loss|night sweats|chills|rash|swelling|abdominal pain|back pain|joint pain|muscle pain|runny nose|sore throat|wheezing)\b"
CHECK_SYNONYMS = (
    ("hipertensao", "hipertensao arterial", "hipertensao arterial sistemica", "has"),
    ("hiperlipidemia", "dislipidemia"),
    ("diabetes", "diabetes mellitus"),
    ("drge", "doenca do refluxo gastroesofagico", "doenca do refluxo gastroesofagico (drge)"),
    ("aids", "sindrome da imunodeficiencia adquirida", "aids (sindrome da imunodeficiencia adquirida)"),
    ("sindrome de raynaud", "fenomeno de raynaud", "doenca de raynaud"),
    ("insuficiencia renal cronica", "doenca renal cronica"),
    ("insuficiencia renal aguda", "lesao renal aguda"),
    ("embolia pulmonar", "tromboembolismo pulmonar"),
    ("insuficiencia cardiaca", "insuficiencia cardiaca congestiva"),
    ("dpoc", "doenca pulmonar obstrutiva cronica", "doenca pulmonar obstrutiva cronica (dpoc)"),
)

# --- fixed values: what errors of an exceeded limit say ---
OVERFLOW = "length|max_tokens|maximum|token limit|finish_reason|lengthfinishreason"
# --- end of fixed values ---
