from . import candidate_queries, detector_queries, dynamics_queries, event_queries, gate_queries, isi_queries, join_queries, model_queries, run_queries, statistics_queries, streaming_queries, validation_queries  # noqa: F401
