"""The rule packs that come with the library.

Fixed values: names, patterns, keywords, columns and keys of the four packs, in
the nested form that rule-pack files use.
"""

from __future__ import annotations

from doctables.sources.profiles import Profile, profile_from


def _column(name, label, kind="string", required=False, aliases=(), **more):
    return {
        "name": name, "display_name": label, "type": kind, "required": required,
        "aliases": list(aliases), **more,
    }


GENERIC_TABLE = {
    "name": "generic_table",
    "display_name": "Generic Tabular Document",
    "document_type": "STRUCTURED_TABLE",
    "recommended_extractor": "pdf_tables",
    "matching_patterns": {"filename_regex": ".*", "keywords": []},
    "columns": [],
    "datasets": [{"id": "primary_table", "primary_key": []}],
}

OCCUPATIONS = {
    "name": "occupations_high_demand",
    "display_name": "Occupations in High Demand (OIHD)",
    "document_type": "SEMI_STRUCTURED_REPORT",
    "recommended_extractor": "occupations",
    "matching_patterns": {
        "filename_regex": "(?i)(oihd|high_demand|occupations_demand|ofo|labour_market)",
        "keywords": [
            "OFO Code", "Occupation Title", "Demand Ranking", "Province", "Major Group",
            "High Demand",
        ],
    },
    "columns": [
        _column("ofo_code", "OFO Code", required=True, pattern="^[0-9]{4,6}$",
                aliases=["OFO Code", "OFO", "Code", "Occupation Code"]),
        _column("occupation_title", "Occupation Title", required=True,
                aliases=["Occupation Title", "Occupation", "Title", "Designation"]),
        _column("demand_rank", "Demand Ranking", "integer",
                aliases=["Demand Ranking", "Rank", "Priority", "Demand Level"]),
        _column("major_group", "Major Group",
                aliases=["Major Group", "Category", "Occupational Group"]),
        _column("province", "Province", aliases=["Province", "Region", "Geo", "Provincial"]),
        _column("educational_qualification_req", "Entry Qualification",
                aliases=["Entry Qualification", "Qualification Required", "Min Education"]),
    ],
    "datasets": [
        {"id": "occupations_high_demand", "primary_key": ["ofo_code", "province"]},
        {"id": "occupation_metadata", "primary_key": ["ofo_code"]},
    ],
}

CODEBOOK = {
    "name": "qlfs_codebook",
    "display_name": "Stats SA QLFS Codebook & Documentation",
    "document_type": "CODEBOOK_METADATA",
    "recommended_extractor": "codebook",
    "matching_patterns": {
        "filename_regex": "(?i)(qlfs|labour_force|codebook|metadata|survey_guide)",
        "keywords": [
            "Variable Name", "Variable Label", "Category Code", "Value Label",
            "Quarterly Labour Force", "Stats SA",
        ],
    },
    "columns": [
        _column("variable_name", "Variable Name", required=True, pattern="^[A-Z0-9_]{2,30}$",
                aliases=["Variable", "Var Name", "Variable_Name", "Field"]),
        _column("variable_label", "Variable Label", required=True,
                aliases=["Variable Label", "Description", "Var Label", "Label"]),
        _column("value", "Value / Code", aliases=["Value", "Code", "Category Code", "Category"]),
        _column("value_label", "Value Label",
                aliases=["Value Label", "Category Label", "Meaning", "Response"]),
        _column("data_type", "Data Type", aliases=["Type", "Data Type", "Format"]),
        _column("description", "Notes / Description",
                aliases=["Notes", "Description", "Universe", "Filter"]),
    ],
    "datasets": [
        {"id": "qlfs_codebook", "primary_key": ["variable_name"]},
        {"id": "qlfs_categories", "primary_key": ["variable_name", "value"]},
    ],
}

QUALIFICATIONS = {
    "name": "tvet_qualifications",
    "display_name": "TVET Occupational Qualifications",
    "document_type": "REPEATED_TABULAR",
    "recommended_extractor": "qualifications",
    "matching_patterns": {
        "filename_regex": "(?i)(tvet|occupational_qualifications|saqa|qualifications_list|college_offering)",
        "keywords": [
            "SAQA ID", "Qualification Title", "NQF Level", "Participating Colleges",
            "Occupational Certificate", "TVET College",
        ],
    },
    "columns": [
        _column("saqa_id", "SAQA ID", required=True, pattern="^[0-9]{5,7}$",
                aliases=["SAQA ID", "SAQA", "Qual ID", "ID"]),
        _column("qualification", "Qualification Title", required=True,
                aliases=["Qualification Title", "Qualification", "Title", "Programme Name"]),
        _column("nqf_level", "NQF Level", "integer", required=True, min_value=1, max_value=10,
                aliases=["NQF Level", "NQF", "Level"]),
        _column("framework", "Framework",
                aliases=["Framework", "Sub-Framework", "OQSF", "HEQSF"]),
        _column("nsfas_eligible", "NSFAS Funded", "boolean",
                aliases=["NSFAS", "NSFAS Eligible", "Funded"]),
        _column("participating_colleges", "Participating Colleges", "list",
                aliases=["Participating Colleges", "TVET Colleges", "Colleges", "Institutions"]),
    ],
    "datasets": [
        {"id": "qualifications", "primary_key": ["saqa_id"]},
        {"id": "qualification_colleges", "primary_key": ["saqa_id", "college_name"]},
    ],
}


def shipped_profiles() -> list[Profile]:
    """All packs in name order, the order ties are broken by."""
    return [profile_from(p) for p in (GENERIC_TABLE, OCCUPATIONS, CODEBOOK, QUALIFICATIONS)]
