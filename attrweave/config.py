"""Options of a run: defaults, then one file or more in .ini form, then keyword arguments.

A file has the options by their names here, in any section, or by the established names of such configuration files (KEYS),
as published experiments use them. Those that no result depends on (IGNORED) are read over with a warning.
"""

from __future__ import annotations

import configparser
import warnings
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    #: Input.
    category: str = ""
    linkage_suffix: str = ""
    excluded_names: tuple[str, ...] = ()
    #: Candidates and matching.
    min_common_values: int = 2
    min_edge_weight: float = 0.2
    error_rate: float = 0.05
    name_weight: float = 0.1
    idf: bool = True
    apriori: float = 0.01
    posterior: bool = True
    weights: str = "no_minweight"
    common_attributes: int = 15
    common_ratio: float = 0.1
    common_token_ratio: float = 0.0
    #: Record linkage, in turn with matching.
    record_linkage: str = "PROB"
    linkage_behavior: str = "BOTH"
    restart_linkage: bool = False
    linkage_same_source: bool = False
    iterations: int = 2
    linkage_apriori: float = 0.01
    min_linkage_weight: float = 0.2
    linkage_without_virtual: bool = False
    stop_similarity: float = 0.98
    stop_identical: float = 0.92
    #: Clusters.
    rule: str = "same_page"
    pages_of_virtual: bool = True
    masters: tuple[str, ...] = ()
    min_external: int = 10
    names: str = "FULL"
    containment: float = 0.8
    domain_share: float = 0.2
    #: Tags.
    dictionary_from: str = "NON_ISOLATED"
    to_tag: str = "TAIL_CLUSTERS"
    every_combination: bool = False
    min_ngram: int = 1
    max_ngram: int = 10
    value_min: int = 2
    value_max: int = 25
    dictionary_least: int = 1
    dictionary_rarity: float = 0.02
    virtual_ratio: float = 0.1
    virtual_least: int = 3
    virtual_score: float = 1.0
    one_cluster: bool = True
    #: Mutual information.
    min_mi: float = 1.0
    mi_pairs: int = 3
    mi_pages: int = 3
    mi_tokens: int = 3
    mi_values: int = 3
    #: Perturbed input: what is taken away for the run comes back for its report.
    linkage_added: float = 0.0
    delete_unlinked: bool = False
    source_rule: str = "NONE"
    sources_kept: int = 0
    sources_mandatory: tuple[str, ...] = ()
    linkage_kept: float = 1.0
    linkage_rule: str = "NONE"
    #: The loop.
    rounds: int = 7
    seed: int = 1

    def but(self, **changes: object) -> Options:
        return replace(self, **changes)


#: Established key: option; "!" before it turns yes into no.
KEYS = {
    "category": "category", "linkage_suffix": "linkage_suffix", "excluded_attribute_names": "excluded_names",
    "max_frequency_single_value": "common_ratio", "min_common_values_attributes": "min_common_values", "min_edge_weight": "min_edge_weight", "error_rate_per_value": "error_rate",
    "similarity_names_weight": "name_weight", "use_idf": "idf", "default_apriori_equivalence_ratio": "apriori", "compute_posterior_probability": "posterior", "one_value_per_product": "weights", "common_token_ratio": "common_token_ratio",
    "record_linkage_method": "record_linkage", "record_linkage_behavior": "linkage_behavior", "restart_linkage": "restart_linkage", "allow_linkage_same_source": "linkage_same_source", "number_of_iterations": "iterations",
    "default_apriori_linkage_ratio": "linkage_apriori", "min_edge_weight_linkage": "min_linkage_weight", "exclude_generated_from_family_linkage": "linkage_without_virtual",
    "min_clustering_similarity_to_stop_iteration": "stop_similarity", "min_elements_in_identical_clusters_to_stop_iteration": "stop_identical",
    "exclude_same_page_for_generated": "!pages_of_virtual", "source_name": "masters", "min_size_external_clusters": "min_external",
    "extract_dict_values_from": "dictionary_from", "attributes_to_tag": "to_tag", "tag_every_combination": "every_combination", "min_ngram": "min_ngram", "max_ngram": "max_ngram", "min_len_atomic_values": "value_min", "max_len_atomic_values": "value_max",
    "min_att_in_cluster": "dictionary_least", "max_ratio_occs": "dictionary_rarity", "min_value_ratio_on_original_attribute": "virtual_ratio", "min_values": "virtual_least", "min_distinct_values_score": "virtual_score", "assign_snippets_one_cluster": "one_cluster",
    "min_mi": "min_mi", "min_sa_pair": "mi_pairs", "min_page_pair": "mi_pages", "min_significant_tokens": "mi_tokens", "min_distinct_values_generated_mi": "mi_values",
    "ratio_linkage_added": "linkage_added", "delete_pages_without_linkage": "delete_unlinked", "source_removal_rule": "source_rule", "number_sources_keep": "sources_kept", "sources_mandatory": "sources_mandatory",
    "percentage_linkage_kept": "linkage_kept", "linkage_removal_rule": "linkage_rule",
}
#: Keys without an effect on clusters: where files are, what is written, and settings that nothing reads.
IGNORED = frozenset(
    "do_output_main_analysis ikgpp_mode clusters_to_compare do_synthetic_evaluation do_separate_isolated specific_nodes_camera debug_mode debug_tags clustering_algorithm keep_previous_original_clusters default_linkage_weight "
    "min_dict_similarity_to_stop_iteration min_terms_in_identical_entries_to_stop_iteration neg_sample_linkage min_blocking_score_linkage min_blocking_linkage_score use_original_linkage_for_training_in_iteration delete_subclusters_only_virtuals "
    "edge_filters initial_blocking_rl extract_atomic_values_only_from_head_clusters add_extraction_data_in_output source_attributes excluded_source_attributes specifications_source specifications_full_path specifications ground_truth_file ground_truth_path "
    "ground_truth_instance_level_file ground_truth_instance_level_path attribute_cardinality attribute_size cluster_distinct_sources attribute_linkage source_size source_linkage".split()
)
_KEPT = {"KEEP_MORE_LINKAGE": "MORE", "KEEP_LESS_LINKAGE": "LESS", "KEEP_BIG_CLUSTERS": "KEEP_BIG", "KEEP_SMALL_CLUSTERS": "KEEP_SMALL"}


def load(*paths: str, **changes: object) -> Options:
    """Options of .ini files, the later over the earlier."""
    parser, found = configparser.ConfigParser(interpolation=None), {}
    parser.read(paths)
    kinds = {f.name: f.type for f in fields(Options)}
    for section in parser.sections():
        for key, text in parser[section].items():
            if key in IGNORED or section in ("local", "experiments"):
                if key not in ("debug_mode", "debug_tags"):
                    warnings.warn(f"option {key} has no effect", stacklevel=2)
                continue
            if key not in kinds and key not in KEYS:
                raise ValueError(f"there is no option {key}")
            name = key if key in kinds else KEYS[key]
            negated, name = name.startswith("!"), name.removeprefix("!")
            kind = kinds[name]
            if kind == "bool":
                found[name] = parser[section].getboolean(key) != negated
            elif kind.startswith("tuple"):
                found[name] = tuple(x.strip() for x in text.split(",") if x.strip())
            else:
                found[name] = {"int": int, "float": float, "str": str}[kind](_KEPT.get(text.strip(), text.strip()))
    options = Options(**(found | changes))
    if options.record_linkage not in ("PROB", "NONE"):
        raise ValueError(f"record linkage is PROB or NONE, not {options.record_linkage}")
    return options
