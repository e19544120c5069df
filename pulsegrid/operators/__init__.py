"""pulsegrid.operators"""
