"""DataFrame-to-DataFrame steps, one concern per module; chain with ``df.transform``."""
