"""Ready-made plans: whole screens, and the operators bound to the test tables."""
