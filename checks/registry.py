"""Names of the registered queries."""

from checks import queries as q

QUERIES = {
    f.__name__: f
    for f in (
        q.parse, q.domain_gate, q.domain_gate_documents, q.labels, q.merged_filters,
        q.cleaned_catalog, q.catalog_csv, q.product_lookup, q.profile, q.catalog_values,
        q.catalog_distinct, q.filter_record, q.strict_matches, q.brand_matches,
        q.relaxed_candidates, q.relaxed_candidates_repeated, q.attribute_items,
        q.attribute_items_repeated, q.attribute_answers, q.documents, q.chunks,
        q.tight_chunks, q.document_chunks, q.ingest_report, q.chunk_coverage,
        q.unit_vectors, q.vector_report, q.nearest_vectors, q.term_counts, q.vocabulary,
        q.term_vectors, q.search_items, q.search_diagnostics, q.search_answers,
        q.form_items, q.rebuilt_items, q.vector_items, q.result_rows, q.reduced_items, q.reduced_vectors, q.evidence,
        q.explanations, q.answered_explanations, q.response_check, q.violations,
        q.order_violations, q.accuracy, q.match_rate, q.passed_checks, q.latency,
        q.report_lines, q.recent,
    )
}
