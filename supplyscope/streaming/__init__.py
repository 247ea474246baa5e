from supplyscope.streaming.receiving_stream import diagnose_stream, operations_stream  # noqa: F401
