"""tallyforge.streaming"""
