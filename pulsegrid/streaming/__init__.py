"""pulsegrid.streaming"""
