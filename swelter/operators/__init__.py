"""The stages of the analysis and its models, as DataFrame transformations."""
