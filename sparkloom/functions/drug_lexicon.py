"""Words of drug names. Everything in this module is a fixed value: the words of hospitals and of the vocabulary."""

from __future__ import annotations

#: Phrases of dose forms (parted by semicolons) = forms of the vocabulary: tiers parted by bars, alternatives by slashes.
FORM_LINES = """
TABLET = Oral Tablet | Chewable Tablet / Disintegrating Oral Tablet
ORAL TABLET; HALF-TAB; TABLETS IN A DOSE PACK; TABLET IN A DOSE PACK; TABLETS IN A STARTER PACK = Oral Tablet
TABLET,DELAYED RELEASE; DELAYED RELEASE TABLET = Delayed Release Oral Tablet
TABLET,EXTENDED RELEASE = Extended Release Oral Tablet | 24 Hour Extended Release Tablet / 12 hour Extended Release Tablet
EXTENDED RELEASE TABLET = Extended Release Oral Tablet | 24 Hour Extended Release Tablet
TABLET,EXTENDED RELEASE 24 HR = 24 Hour Extended Release Tablet | Extended Release Oral Tablet
TABLET,EXTENDED RELEASE 12 HR = 12 hour Extended Release Tablet | Extended Release Oral Tablet
TABLET,DISPERSIBLE; TABLET,DISINTEGRATING; DISINTEGRATING TABLET = Disintegrating Oral Tablet
CHEWABLE TABLET; TABLET,CHEWABLE = Chewable Tablet
SUBLINGUAL TABLET; TABLET,SUBLINGUAL = Sublingual Tablet
BUCCAL TABLET = Buccal Tablet
EFFERVESCENT TABLET = Effervescent Oral Tablet
VAGINAL TABLET = Vaginal Tablet
CAPSULE; ORAL CAPSULE; CAPSULE,SPRINKLE; CAPSULES IN A DOSE PACK = Oral Capsule
CAPSULE,DELAYED RELEASE; DELAYED RELEASE CAPSULE; CAPSULE,DELAYED RELEASE SPRINKLE = Delayed Release Oral Capsule
CAPSULE,EXTENDED RELEASE = Extended Release Oral Capsule | 24 Hour Extended Release Capsule / 12 hour Extended Release Capsule
EXTENDED RELEASE CAPSULE; CAPSULE,EXTENDED RELEASE PELLETS = Extended Release Oral Capsule
CAPSULE,EXTENDED RELEASE 24 HR = 24 Hour Extended Release Capsule | Extended Release Oral Capsule
INJECTION SOLUTION; SOLUTION FOR INJECTION; INJ SOLN; SOLN FOR INJ = Injection / Injectable Solution | Intravenous Solution
INJECTABLE SOLUTION = Injection / Injectable Solution
INJECTION = Injection | Injectable Solution / Intravenous Solution
INTRA-CATHETER SOLUTION; INTRACATHETER SOLUTION; INJECTABLE EMULSION; INJECTION EMULSION; SUBCUTANEOUS SOLUTION; SUBCUTANEOUS SOLN; SUBCUTANEOUS INJECTION; VIAL; AMPULE; AMPUL; SUBCUTANEOUS = Injectable Solution | Injection
SUSPENSION FOR INJECTION; INJECTION SUSPENSION = Injectable Suspension | Injection
INTRAMUSCULAR SOLUTION = Intramuscular Solution | Injection / Injectable Solution
SYRINGE; INJECTION SYRINGE; PREFILLED SYRINGE; SUBCUTANEOUS SYRINGE; INTRAVENOUS SYRINGE = Prefilled Syringe | Injection / Injectable Solution
IM SYRINGE; INTRAMUSCULAR SYRINGE = Prefilled Syringe | Intramuscular Solution / Injection
PEN; SUBCUTANEOUS PEN; PEN INJECTOR = Pen Injector | Injection / Injectable Solution
AUTO-INJECTOR = Auto-Injector | Prefilled Syringe / Injection
CARTRIDGE; INTRAVENOUS CARTRIDGE = Cartridge | Injection / Injectable Solution
INTRAVENOUS SOLUTION; INTRAVENOUS EMULSION; IV SOLUTION; IV SOLN; IV BOLUS; INTRAVENOUS PIGGYBACK; IV SOLUTION PREMIX; INTRAVENOUS PREMIX = Intravenous Solution | Injection / Injectable Solution
INTRAVENOUS; IV = Intravenous Solution | Injection / Injectable Solution | Prefilled Syringe / Cartridge
GIVEN INTRAVENOUSLY = Injection / Injectable Solution | Intravenous Solution | Prefilled Syringe / Cartridge
ORAL SOLUTION; ORAL LIQUID; ORAL ELIXIR; ORAL SYRUP; ORAL CONCENTRATE; SOLUTION = Oral Solution
ORAL SYRINGE = Oral Solution | Oral Suspension
ORAL SUSPENSION; ORAL SUSP; SUSPENSION = Oral Suspension
ORAL POWDER; ORAL POWDER PACKET; POWDER PACKET = Oral Powder | Powder for Oral Solution
ORAL PACKET = Oral Powder | Powder for Oral Solution / Oral Granules
PACKET = Oral Powder | Oral Granules
POWDER FOR ORAL SOLUTION = Powder for Oral Solution | Oral Powder
POWDER FOR ORAL SUSPENSION = Powder for Oral Suspension | Oral Powder
ORAL GRANULES; GRANULES = Oral Granules
ORAL GEL = Oral Gel
ORAL PASTE = Oral Paste
ORAL LOZENGE; LOZENGE; TROCHE = Oral Lozenge
CHEWING GUM; GUM = Chewing Gum
ORAL FILM = Oral Film
ORAL STRIP = Oral Strip
SUBLINGUAL FILM = Sublingual Film
BUCCAL FILM = Buccal Film
SOLUTION FOR NEBULIZATION; NEBULIZER SOLUTION; NEBULIZATION SOLUTION; NEBULIZATION SOLN; SOLUTION FOR INHALATION; INHALATION SOLUTION; INHALATION SOLN = Inhalation Solution
AEROSOL INHALER = Metered Dose Inhaler | Inhalation Spray / Dry Powder Inhaler
METERED DOSE INHALER = Metered Dose Inhaler
INHALATION AEROSOL; AEROSOL; RESPIMAT = Metered Dose Inhaler | Inhalation Spray
INHALER = Metered Dose Inhaler | Dry Powder Inhaler
DISKUS; DRY POWDER INHALER = Dry Powder Inhaler
INHALATION POWDER = Inhalation Powder | Dry Powder Inhaler
NASAL SPRAY; NASAL SPRAY,SOLUTION = Nasal Spray | Metered Dose Nasal Spray / Nasal Solution
NASAL SPRAY,SUSPENSION = Nasal Spray | Metered Dose Nasal Spray / Nasal Suspension
NASAL SOLUTION = Nasal Solution | Nasal Spray
NASAL INHALER = Nasal Inhaler | Metered Dose Nasal Spray
EYE DROPS; OPHTHALMIC DROPS = Ophthalmic Solution | Ophthalmic Suspension
EYE DROPS,SOLUTION; OPHTHALMIC SOLUTION = Ophthalmic Solution
EYE DROPS,SUSPENSION = Ophthalmic Suspension | Ophthalmic Solution
OPHTHALMIC SUSPENSION = Ophthalmic Suspension
EYE OINTMENT; OPHTHALMIC OINTMENT = Ophthalmic Ointment
EYE GEL = Ophthalmic Gel
EAR DROPS = Otic Solution | Otic Suspension
EAR DROPS,SUSPENSION = Otic Suspension | Otic Solution
OTIC SOLUTION = Otic Solution
OTIC SUSPENSION = Otic Suspension
TOPICAL CREAM; CREAM = Topical Cream
TOPICAL OINTMENT; OINTMENT = Topical Ointment
TOPICAL GEL; GEL = Topical Gel
TOPICAL LOTION; LOTION = Topical Lotion
TOPICAL SOLUTION = Topical Solution
TOPICAL SPRAY; TOPICAL AEROSOL = Topical Spray
TOPICAL FOAM = Topical Foam
TOPICAL POWDER = Topical Powder
TOPICAL PATCH; PATCH = Medicated Patch | Transdermal System
MEDICATED PATCH = Medicated Patch
TRANSDERMAL PATCH = Transdermal System | Medicated Patch
TRANSDERMAL SYSTEM = Transdermal System
TRANSDERMAL PATCH 24 HR = 24 Hour Transdermal Patch | Transdermal System
TRANSDERMAL PATCH 72 HR = 72 Hour Transdermal Patch | Transdermal System
MEDICATED PAD = Medicated Pad
RECTAL SUPPOSITORY; SUPPOSITORY = Rectal Suppository
VAGINAL SUPPOSITORY = Vaginal Suppository
RECTAL SOLUTION = Rectal Solution | Enema
RECTAL ENEMA; ENEMA = Enema | Rectal Solution
RECTAL CREAM = Rectal Cream
RECTAL GEL = Rectal Gel
RECTAL FOAM = Rectal Foam
VAGINAL CREAM = Vaginal Cream
VAGINAL GEL = Vaginal Gel
VAGINAL RING = Vaginal Ring
VAGINAL INSERT = Vaginal Insert
MOUTHWASH; MOUTH WASH; ORAL RINSE = Mouthwash
MUCOSAL SOLUTION = Mucous Membrane Topical Solution
IRRIGATION SOLUTION; IRRIGATION = Irrigation Solution
SHAMPOO = Medicated Shampoo
SOAP = Medicated Bar Soap | Medicated Liquid Soap
TOOTHPASTE = Toothpaste
OIL = Oil
PASTE = Paste
STICK = Stick
IMPLANT; DRUG IMPLANT = Drug Implant
PACK; KIT = Pack
"""

#: Unit words = code of the unit in the vocabulary.
UNIT_LINES = """
MG; MGS; MILLIGRAM; MILLIGRAMS = mg
G; GM; GRAM; GRAMS = g
MCG; UG; MICROGRAM; MICROGRAMS = ug
NG; NANOGRAM = ng
ML; MILLILITER; MILLILITERS; CC = mL
L; LITER = L
UNIT; UNITS; UNT; ANTI-XA UNIT; ANTI-XA UNITS; ANTI-XA = [U]
IU = [iU]
MEQ; MILLIEQUIVALENT = 10*-3.eq
MMOL = mmol
MCI; MILLICURIE = mCi
% = %
ACTUATION; ACTUAT; PUFF = {actuat}
HR; HOUR; HOURS = h
"""

#: Code of a unit = family and factor to its base; units of different families are never compared.
FAMILY_LINES = """
mg = mass 1
g = mass 1000
ug = mass 0.001
ng = mass 0.000001
kg = mass 1000000
mL = volume 1
L = volume 1000
[U] = unit 1
[iU] = unit 1
[USP'U] = usp_unit 1
10*-3.eq = milliequivalent 1
mmol = millimole 1
mol = millimole 1000
% = percent 1
{actuat} = actuation 1
mCi = millicurie 1
h = hour 1
min = hour 0.016666666666666666
cm2 = area 1
"""

#: Words of salts and hydrates at the end of an ingredient's name.
SALTS = """
HYDROCHLORIDE HCL SULFATE SUCCINATE TARTRATE BITARTRATE MALEATE MESYLATE BESYLATE FUMARATE CITRATE ACETATE PHOSPHATE
GLUCONATE LACTATE CARBONATE NITRATE BROMIDE TROMETHAMINE DISODIUM HYDROBROMIDE PAMOATE VALERATE PROPIONATE DIPROPIONATE
FUROATE XINAFOATE ACETONIDE MONOHYDRATE ANHYDROUS HYCLATE MONONITRATE DINITRATE AXETIL ESTOLATE PALMITATE EDISYLATE
LACTOBIONATE TOSYLATE OXALATE SALICYLATE STEARATE BENZOATE BORATE
""".split()

#: Words that say how a drug is given or supplied, not what it is.
NOISE = (
    "IVPB", "IVP", "IV PUSH", "CHEMO", "INFUSION", "PREMIX", "PREPACK", "PCA", "BOLUS FROM BAG", "CASSETTE", "COMPOUNDED",
    "NS", "D5W", "D10W", "D5NS", "D50W", "LR", "VARIABLE DOSE", "CUSTOM DOSE", "RANGE DOSE", "DEFAULT", "TOTAL VOLUME",
    "FOR INPATIENTS", "FOR ADULTS", "PER UNIT", "STANDARD", "HFA", "MDI", "PF",
)

#: Words after which a name without a dose form is read as given into a vein; names of bags say so too.
VEIN = ("IVPB", "IVP", "IV PUSH", "IV BOLUS", "BOLUS FROM BAG", "INFUSION", "PREMIX", "PIGGYBACK", "PCA", "IV")
BAGS = ("NS", "D5W", "D10W", "D5NS", "LR")

#: What drugs are dissolved in, and the strengths in which it is written before its name.
DILUENT = (
    r"(?:SODIUM CHLORIDE|SOD\.?\s*(?:CHLORIDE|CHLOR|CHL|CH|C)?|NORMAL SALINE|SALINE|STERILE WATER|WATER|DEXTROSE|NACL"
    r"|D5 1/2 NS|D5NS|D5W|D50W|D10W|NS|LR)"
)
DILUENT_PERCENTS = r"(?:0\.9|0\.45|0\.225|5|10)"

#: What a parenthesis may hold that says how a product is supplied or for whom.
ASIDE = (
    r"(?:PF|TOTAL VOLUME|PER DROP|ADULTS|PEDS|DEFAULT[^)]*|DOSE[^)]*|QS[^)]*|NO DOSE ROUNDING|FOR [^)]*|ISO-OSMOTIC|ISO-OSMOT"
    r"|PRESERVATIVE FREE|FLUSH|\d+\s*MIN|U-\d+|PART/CRYST|\d+\s*(?:TABS?|TABLETS?|CAPS?|CAPSULES?|COUNT|EA|EACH)?)"
)

#: Short forms of words in ingredients' names, and of release rates beside them.
SHORT = {
    "SOD": "SODIUM", "SODIUM": "SODIUM", "SUCC": "SUCCINATE", "MAG": "MAGNESIUM", "POT": "POTASSIUM", "BICARB": "BICARBONATE",
    "CHLOR": "CHLORIDE", "PHOS": "PHOSPHATE", "HYDROCHLOR": "HYDROCHLORIDE", "CARB": "CARBONATE", "GLUC": "GLUCONATE",
    "TMP": "TRIMETHOPRIM", "SMX": "SULFAMETHOXAZOLE",
}
RELEASE = {"EXTENDED RELEASE": ("ER", "XR", "XL", "SR", "CR"), "DELAYED RELEASE": ("DR", "EC")}

#: Elements that a strength may count instead of the whole molecule.
ELEMENTS = ("IODINE", "IRON", "CALCIUM", "PHOSPHORUS", "MAGNESIUM", "POTASSIUM", "SODIUM", "ZINC", "ELEMENTAL IRON", "ELEMENTAL CALCIUM", "BASE")

#: Words that a vocabulary's name may have beyond the source's and still name the same ingredient.
ALSO_SALTS = ("sodium", "potassium", "calcium", "magnesium")


def _lines(text: str) -> dict[str, str]:
    rows = (line.rsplit(" = ", 1) for line in text.strip().splitlines())
    return {name.strip(): value for names, value in rows for name in names.split(";")}


#: phrase -> tiers of alternatives; unit word -> code; code -> (family, factor)
FORMS = {phrase: [[f.strip() for f in tier.split("/")] for tier in tiers.split("|")] for phrase, tiers in _lines(FORM_LINES).items()}
UNITS = _lines(UNIT_LINES)
FAMILIES = {code: (v.split()[0], float(v.split()[1])) for code, v in _lines(FAMILY_LINES).items()}
