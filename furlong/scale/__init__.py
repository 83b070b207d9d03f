"""Building blocks that keep a plan spread out when keys are skewed."""
