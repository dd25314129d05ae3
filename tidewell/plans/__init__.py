from tidewell.plans import analyst, cleaning, files, grading, requests, streams, support, texts  # noqa: F401
