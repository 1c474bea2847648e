"""Training-data operators: one module per operator; nothing else in attrweave imports this package."""
