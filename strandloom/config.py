"""Parameters of the analyses, with their defaults by kind of data."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Parameters:
    """Limits and thresholds; distances are in positions, ratios in [0, 1]."""

    min_mapping_quality: int = 1
    max_num_cigar: int = 10_000
    max_read_span: int = 500_000
    use_second_alignment: bool = True
    uniquely_mapped_only: bool = False
    min_bundle_gap: int = 200
    region_length: int = 1_000_000
    min_junction_support: int = 1
    min_splice_similarity: float = 0.10
    high_splice_similarity: float = 0.80
    max_group_size: int = 200
    max_junctions_compared: int = 500
    max_reads_partition_gap: int = 10
    min_subregion_gap: int = 15
    min_subregion_length: int = 15
    min_subregion_overlap: float = 1.5
    support_distance: int = 200
    insertsize_low: int = 80
    insertsize_high: int = 500
    bridge_candidates: int = 10
    bridge_stack: int = 5
    bridge_end_relaxing: int = 10
    min_transcript_coverage: float = 2.0
    max_decompose_ratio: float = 0.30
    min_phase_count: int = 2
    single_exon_overlap: float = 0.80
    min_guaranteed_weight: float = 0.01
    score_threshold: float = 0.2
    min_single_exon_length: int = 250
    min_single_exon_coverage: float = 3.5
    min_transcript_length_base: int = 100
    min_transcript_length_increase: int = 20
    min_exon_length: int = 8
    boundary_ratio: float = 2.0
    max_boundary_distance: int = 10_000
    group_boundaries: bool = False
    adjacent_weight: float = 0.5


# what long reads change
LONG_READS = {
    "pacbio_ccs": {"min_junction_support": 1},
    "pacbio_sub": {"min_junction_support": 2},
    "ont": {"min_junction_support": 2},
}
DATA_TYPES = {"default": 0, "paired_end": 1, "single_end": 2, "pacbio_ccs": 3, "pacbio_sub": 4, "ont": 5}


def for_data_type(name: str, base: Parameters = Parameters()) -> Parameters:
    if name not in DATA_TYPES:
        raise ValueError(f"unknown protocol: {name}")
    return replace(base, **LONG_READS.get(name, {}))
