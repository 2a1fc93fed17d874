"""Schemas of the stored tables, as DDL strings Spark parses itself.

Surrogate keys are 64-bit integers; all measures are doubles. The partition
column of every experiment-scoped table is ``experiment_id``.
"""

from __future__ import annotations

from pyspark.sql import types as T

MUTATION_STRUCT = (
    "struct<mutation_type:string, codon_index_1based:int, aa_position_1based:int, "
    "wt_codon:string, var_codon:string, wt_aa:string, var_aa:string, notes:string>"
)

ANALYSIS_STRUCT = (
    "struct<mutations:array<" + MUTATION_STRUCT + ">, "
    "mutation_counts:struct<synonymous:int, nonsynonymous:int, total:int>>"
)

DDL = {
    "wild_type_proteins": (
        "wt_id bigint, user_id bigint, uniprot_id string, protein_name string, organism string, "
        "amino_acid_sequence string, sequence_length int, plasmid_sequence string"
    ),
    "protein_features": (
        "feature_id bigint, wt_id bigint, feature_type string, description string, "
        "start_position int, end_position int, evidence string"
    ),
    "experiments": (
        "experiment_id bigint, user_id bigint, wt_id bigint, name string, description string, "
        "status string, extra_metadata map<string,string>, created_at timestamp"
    ),
    "generations": "generation_id bigint, experiment_id bigint, generation_number int",
    "variants": (
        "variant_id bigint, experiment_id bigint, generation_id bigint, generation_number int, "
        "parent_variant_id bigint, plasmid_variant_index string, assembled_dna_sequence string, "
        "protein_sequence string, extra_metadata map<string,string>, "
        "sequence_analysis " + ANALYSIS_STRUCT
    ),
    "mutations": (
        "mutation_id bigint, variant_id bigint, mutation_type string, position int, "
        "original string, mutated string, is_synonymous boolean, annotation string"
    ),
    "wild_type_controls": "wt_control_id bigint, generation_id bigint, wt_id bigint",
    "metrics": (
        "metric_id bigint, generation_id bigint, variant_id bigint, wt_control_id bigint, "
        "metric_name string, metric_type string, value double, unit string, "
        "metric_definition_id bigint"
    ),
    "metric_definitions": "metric_definition_id bigint, name string, metric_type string, unit string",
    "experiment_metadata": "experiment_id bigint, field_name string, field_value string",
    "staging_validations": (
        "experiment_id bigint, is_valid boolean, identity double, coverage double, strand string, "
        "start_nt int, end_nt int, wraps boolean, message string, created_at timestamp"
    ),
    "variant_sequence_analysis": (
        "variant_id bigint, cds_start_0based int, cds_end_0based_excl int, strand string, frame int, "
        "is_circular_wrap boolean, status string, qc_notes string, has_frameshift boolean, "
        "has_premature_stop boolean, has_ambiguous_bases boolean, "
        "analysis " + ANALYSIS_STRUCT + ", created_at timestamp, updated_at timestamp"
    ),
    "upload_files": (
        "experiment_id bigint, file_path string, status string, error string, record_count bigint, "
        "findings array<struct<level:string, code:string, occurrences:bigint>>"
    ),
    "variant_lineage_closure": "ancestor_id bigint, descendant_id bigint, distance int",
    "variant_performance_rankings": (
        "generation_id bigint, variant_id bigint, metric_name string, metric_type string, "
        "value double, rank bigint"
    ),
    "mutation_introduction_events": (
        "variant_id bigint, position int, original string, mutated string, "
        "introduced_variant_id bigint, introduced_generation int"
    ),
    "embedding_runs": (
        "embedding_run_id bigint, experiment_id bigint, method string, metric_name string, "
        "metric_type string, params map<string,string>, created_at timestamp"
    ),
    "embedding_points": "embedding_run_id bigint, variant_id bigint, x double, y double, z double",
}

# The metric definitions every experiment starts with.
METRIC_DEFINITIONS = [
    (1, "dna_yield_raw", "raw", "fg"),
    (2, "protein_yield_raw", "raw", "pg"),
    (3, "dna_yield_norm", "normalized", "ratio"),
    (4, "protein_yield_norm", "normalized", "ratio"),
    (5, "activity_score", "derived", "ratio"),
]


def struct_of(table: str) -> T.StructType:
    """``StructType`` of a stored table."""
    return T.StructType.fromDDL(DDL[table])
